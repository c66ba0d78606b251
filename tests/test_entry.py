"""The driver contract, with every SQL comparison at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import _canonical
from checks.registry import queries as registered

FOLDER = Path("/root/testdata/sf0.001")
NO_SQL = {
    f"{name}"
    for which in ("floral", "lawn")
    for name in (
        f"{which}_nmds_scores", f"{which}_nmds_stress", f"{which}_nmds_centroids",
        f"fig_{which}_ordination",
    )
}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_but_the_ordination_has_sql():
    names = set(registered())
    assert names - set(contract.oracle_sql()) == NO_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


CHOSEN = [
    "nb_summary", "house_totals", "distinct_traits", "richness_evenness", "color_area",
    "layer_richness", "type_richness_by_income", "front_back", "native_richness", "native_cover",
    "item_importance", "pearson_income", "floral_bray_curtis", "floral_permanova_stat",
    "floral_dispersion", "missing_value_rules", "anova_by_group", "kendall_ordinal",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, connection, name):
    mine = contract.queries()[name](spark, str(FOLDER)).toPandas()
    theirs = connection.execute(contract.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _canonical(mine) == _canonical(theirs)
