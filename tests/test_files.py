"""The whole analysis from CSV files equals the same analysis from tables."""

from pathlib import Path

import pytest

from quadrat.__main__ import main
from quadrat.plans import inference
from quadrat.plans.catalogue import catalogue
from quadrat.session import materialise
from quadrat.sources import star
from quadrat.sources.study import FILES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The study's seven tables written as CSV, missing as NA, blanks as blanks."""
    folder = tmp_path_factory.mktemp("files")
    study = star.study(spark, str(FOLDER))
    data = inference.prepare(study)
    direct = materialise(
        star.direct_house(study.survey_parcel, data.rows, data.cover), "direct"
    )
    tables = {
        "nb_info": study.nb_info.drop("med_inc_short"),
        "floral": study.floral,
        "lawn": study.lawn,
        "native_lawn": study.native_lawn,
        "survey_parcel": study.survey_parcel,
        "direct_house": direct,
        "water_cons": direct.select("watercons", "water_wghtd_avg"),
    }
    for name, df in tables.items():
        df.write.csv(f"{folder}/{FILES[name]}", header=True, nullValue="NA", emptyValue="")
    return study, folder


def rounded(df):
    rows = []
    for r in df.collect():
        rows.append(
            tuple(f"{r[c]:.6g}" if isinstance(r[c], float) else str(r[c]) for c in sorted(df.columns))
        )
    return sorted(rows)


COMPARED = [
    "nb_summary", "traits", "color_area", "layer_richness", "lawn_types", "lawn_natives",
    "item_importance", "income_correlations", "regression_terms", "interaction_anova",
    "floral_dispersion_groups",
]
WRITTEN = [*COMPARED, "preference_correlations", "fig_water_by_attitude", "fig_types_by_income"]


def test_files_give_the_same_tables(spark, files, tmp_path):
    study, folder = files
    main([str(folder), str(tmp_path), *WRITTEN], spark)
    direct = catalogue(study)
    for name in COMPARED:
        assert rounded(spark.read.parquet(f"{tmp_path}/{name}")) == rounded(direct[name]()), name
    tests = spark.read.parquet(f"{tmp_path}/preference_correlations").collect()
    assert {r["comparison"] for r in tests} == {f"{x} ~ {y}" for x, y in inference.PREFERENCE_PAIRS}
    assert all(0 <= r["p_value"] <= 1 for r in tests)
    assert spark.read.parquet(f"{tmp_path}/fig_water_by_attitude").count() > 0


def test_unknown_table_is_refused(spark, files, tmp_path):
    with pytest.raises(SystemExit):
        main([str(files[1]), str(tmp_path), "no_such_table"], spark)
