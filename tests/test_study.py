"""CSV clean-up and the study's tables on a small hand-written study."""

import pytest

from quadrat.plans import communities, figures, floral, lawn, survey
from quadrat.sources import study as st

FILES = {
    "nb_info.csv": """Nb,Med_Inc,Yr_Built.x,Ave_Elev,Ann_Precip,nb_age,nb_inc,city,Type
n1,50000,1950,1300,400,old,low,Town,x
n2,90000,1990,1400,500,new,high,Town,x
""",
    "floral.csv": """Nb,Block,House_ID,Family,Genus,Front/Back,#F stems,# F plants,Flower Width (cm),Flower Length (cm),ave_flower_perstem,Water_man,Native_man,color1,color2,Inf Type,Symmetry,flowertype,photo_ID,notes
n1,b1,h1,Rosaceae,Rosa,Front,10,2,2,3,4,1,0,Red,,head,radial,single,p1,
n1,b1,h1,Rosaceae,Rosa,Back,5,2,n/a,3,1,n/a,1,Red,White,NA,Unknown,single,p2,
n1,b1,h2,NoFlowers,NoFlowers,Front,0,0,,,0,NA,n/a,NoFlowers,,NoFlowers,NoFlowers,NoFlowers,p3,
n2,b1,h3,Asteraceae,Aster,Front,bad,4,1,1,2,3,1,brown,Blue,head,radial,double,p4,"kept, quoted"
NA,b1,h9,Asteraceae,Aster,Front,1,1,1,1,1,1,1,Blue,,head,radial,single,p5,
n2,b1,387_11_4,Asteraceae,Aster,Front,1,1,1,1,1,1,1,Blue,,head,radial,single,p6,
""",
    "plots.csv": """Nb,Block,House_ID,Species,F1,F2,B1,B2,N.fixer,Veg_Garden,VG,notes
n1,b1,h1,Poa,10,20,30,40,0,,,
n1,b1,h1,Trifolium,10,NA,5,5,1,,,
n1,b1,h4,Poa,NA,NA,NA,1,0,,,
n2,b1,h3,NO LAWN,0,0,0,0,0,,,
n2,b1,h3,Not collected,NA,NA,NA,NA,NA,,,
n2,b1,651_1_4,Poa,1,1,1,1,0,,,
""",
    "native_lawn.csv": "Species,Native_merge,Type\nPoa,0,Lawn\nTrifolium,1,Weed\n",
    "survey_parcel.csv": """PARCEL_ID,House_ID,Nb,A6,A8,A902,A909
p1,h1,n1,1,3,2,1
p2,h2,n1,2,n/a,NA,2
p3,110_2_1,n1,3,0,0,3
p4,h3,n2,,1,3,0
""",
    "direct_house.csv": "A902,color.num_F\n2,3\n",
    "water_cons.csv": "Watercons,water_wghtd_avg\n1.5,NA\n",
}


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    return st.read_study(spark, str(folder), {"lawn": "plots.csv"})


@pytest.fixture(scope="module")
def rows(study):
    return floral.clean_rows(study.floral).cache()


def one(df, **where):
    kept = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(kept) == 1
    return kept[0]


def test_headers_raw_or_rewritten_give_the_same_names():
    assert st.column_name("#F stems") == st.column_name("X.F.stems") == "flower_stems"
    assert st.column_name("# F plants") == st.column_name("X..F.plants") == "flower_plants"
    assert st.column_name("Flower Width (cm)") == "flower_width_cm"
    assert st.column_name("Front/Back") == st.column_name("Front.Back") == "front_back"
    assert st.column_name("House_ID") == "house_id"


def test_blank_text_stays_blank_and_na_is_missing(study):
    r = one(study.floral, photo_id="p1")
    assert r["color2"] == "" and r["notes"] == ""
    r = one(study.floral, photo_id="p2")
    assert r["inf_type"] is None and r["water_man"] == "n/a"
    assert one(study.floral, photo_id="p4")["notes"] == "kept, quoted"
    assert one(study.water_cons)["water_wghtd_avg"] is None
    assert one(study.nb_info, nb="n1")["med_inc_short"] == 50.0


def test_clean_rows(rows):
    assert sorted(r["photo_id"] for r in rows.collect()) == ["p1", "p2", "p3", "p4"]
    r = one(rows, photo_id="p1")
    assert (r["flower_size"], r["num_flowers"], r["total_flower_area"]) == (6.0, 40.0, 0.024)
    assert (r["water_wghtd"], r["num_plants_water"], r["native_plants"]) == (2.0, "2", 0.0)
    r = one(rows, photo_id="p2")
    assert r["flower_size"] is None and r["water_wghtd"] is None and r["num_plants_water"] == "n/a"
    r = one(rows, photo_id="p3")
    assert r["num_plants_water"] is None and r["native_bin"] is None
    assert one(rows, photo_id="p4")["num_flowers"] is None


def test_house_totals_follow_the_rule_of_each_column(rows):
    houses = floral.house_totals(rows)
    r = one(houses, house_id="h1")
    assert r["total_plants"] == 4.0 and r["total_plants_water"] == 2.0
    assert r["total_area"] == 0.024 and r["sd_size"] is None and r["total_natives"] == 2.0
    assert r["water_wghtd_avg"] == 1.0
    r = one(houses, house_id="h2")
    assert r["total_plants"] == 0.0 and r["total_plants_water"] is None
    assert r["total_area"] == 0.0 and r["avg_size"] is None and r["water_wghtd_avg"] is None
    r = one(houses, house_id="h3")
    assert r["total_flowers"] is None and r["total_area"] == 0.0


def test_neighbourhood_totals(rows, study):
    r = one(floral.neighbourhood_totals(floral.house_totals(rows), study.nb_info), nb="n1")
    assert r["plants"] == 2.0 and r["n_plants"] == 2 and r["se_plants"] == pytest.approx(2.0)
    assert r["m_size"] is None and r["m_water"] == 1.0 and r["city"] == "Town"


def test_traits(rows):
    houses = floral.house_traits(rows)
    r = one(houses, house_id="h1")
    assert (r["inflo_num"], r["color_num"], r["sym_num"], r["sd_num"], r["genera_num"]) == (2, 2, 1, 1, 1)
    r = one(houses, house_id="h2")
    assert (r["inflo_num"], r["color_num"], r["sym_num"], r["sd_num"], r["genera_num"]) == (0,) * 5


def test_color_area_splits_and_drops_unmapped(rows, study):
    got = {(r["color"], r["income"]): r["color_area"] for r in floral.color_area(rows, study.nb_info).collect()}
    assert got == {("Red", "Low"): 0.024, ("White", "Low"): 0.0, ("Blue", "High"): 0.0}


def test_front_back(rows, study):
    r = one(floral.front_back(rows, study.nb_info), nb="n1", front_back="Front")
    assert r["plants"] == 1.0 and r["n_houses"] == 2 and r["richness_char"] == "0.5"


def test_native_richness_fills_zero(rows, study):
    link = floral.house_neighbourhoods(study.floral)
    houses = {r["house_id"]: r["natives_rich"] for r in floral.house_native_richness(rows, link).collect()}
    assert houses == {"h1": 1, "h2": 0, "h3": 1}


def test_water_need_keeps_missing_class(rows):
    r = one(floral.water_need(rows), taxon="NoFlowers NoFlowers")
    assert r["water_man"] is None and r["plants"] == 0.0 and r["water_weighted"] is None


@pytest.fixture(scope="module")
def cover(study):
    return lawn.species_cover(study.lawn, study.native_lawn).cache()


def test_species_cover(cover):
    assert cover.count() == 3
    assert one(cover, house_id="h1", species="Poa")["ave_cov_all"] == 25.0
    r = one(cover, species="Trifolium")
    assert r["ave_cov_f"] is None and r["ave_cov_all"] == 5.0 and r["type"] == "Weed"
    assert one(cover, house_id="h4")["ave_cov_all"] is None


def test_lawn_summaries(cover, study):
    houses = lawn.house_summary(cover)
    r = one(houses, house_id="h1")
    assert (r["sum_nitrogen"], r["sum_native_sp"], r["sum_native_cover"]) == (1.0, 1.0, 5.0)
    assert one(houses, house_id="h4")["sum_native_cover"] == 0.0
    kinds = {r["type"]: r["avg_cover"] for r in lawn.cover_by_type(cover).collect()}
    assert kinds == {"Lawn": None, "Weed": 5.0}
    natives = {r["house_id"]: r["native_cover"] for r in lawn.house_natives(cover).collect()}
    assert natives == {"h1": 5.0, "h4": None}


def test_lawn_house_without_cover_has_no_richness(cover):
    got = {r["house_id"]: r["l_richness"] for r in lawn.house_diversity(cover).collect()}
    assert got == {"h1": 2.0}


def test_houses_of_unknown_neighbourhood_form_a_group(cover, study):
    link = floral.house_neighbourhoods(study.floral)
    types = lawn.type_richness(cover, link, study.nb_info)
    r = one(types, med_inc_short=None, type="Turfgrasses")
    assert r["n"] == 1 and r["type_mean"] == 1.0


def test_layers_fill_zero_on_both_sides(rows, cover, study):
    link = floral.house_neighbourhoods(study.floral)
    table = floral.layer_richness(rows, lawn.house_richness(cover), link, study.nb_info)
    r = one(table, nb="n1", variable="Lawn species")  # h1 has 2, h2 none, h4 one
    assert r["num_species"] == 1.0 and r["n"] == 3
    r = one(table, nb="n1", variable="Flowering plant genera")
    assert r["num_species"] == pytest.approx(1 / 3)


def test_item_importance_melts_every_column(study):
    items = {r["variable"]: r for r in survey.item_importance(study.survey_parcel).collect()}
    assert set(items) == {"NB", "Natives", "Biodiversity", "Flower Color", "A909"}
    assert items["NB"]["importance"] is None and items["NB"]["n"] == 0
    assert items["Natives"]["n"] == 3 and items["Natives"]["importance"] == 2.0


def test_attitude_counts_differ_by_item(study):
    info = study.nb_info
    answered = survey.attitude_by_neighbourhood(study.survey_parcel, info, "a8", count_missing=False)
    assert one(answered, nb="n1")["n"] == 1
    everyone = survey.attitude_by_neighbourhood(study.survey_parcel, info, "a902", count_missing=True)
    assert one(everyone, nb="n1")["n"] == 2


def test_communities(rows, study):
    flowers = communities.floral_community(rows, study.nb_info)
    assert {(r["site"], r["taxon"]): r["abundance"] for r in flowers.collect()} == {
        ("n1_b1", "Rosaceae_Rosa"): 4.0, ("n2_b1", "Asteraceae_Aster"): 4.0,
    }
    plots = communities.lawn_community(study.lawn, study.nb_info)
    got = {(r["site"], r["taxon"]): r["abundance"] for r in plots.collect()}
    assert got[("n1_b1", "Trifolium")] == pytest.approx(20 / 3)
    assert got[("n2_b1", "Not collected")] is None
    assert communities.plot_covers(study.lawn).count() == 20
    wide = one(communities.community_matrix(plots, communities.LAWN_ATTRIBUTES), nb="n1")
    assert wide["Not collected"] == 0.0 and wide["Poa"] == pytest.approx(101 / 5)


def test_figure_tables(study):
    items = survey.item_importance(study.survey_parcel)
    bars = figures.importance_bars(items, survey.GENERAL_ITEMS).collect()
    assert [r["variable"] for r in bars] == ["Biodiversity", "Natives"]
    assert bars[1]["upper"] == pytest.approx(bars[1]["importance"] + bars[1]["se"])
