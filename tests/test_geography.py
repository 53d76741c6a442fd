import pytest
from conftest import tuples

from accesslens.operators import geography
from accesslens.plans.rollups import rollup
from accesslens.plans.views import region_view
from accesslens.sources.countries import country_table, read_countries
from accesslens.sources.readers import read_cities
from accesslens.sources.writers import write_days
from contract import fixture


def hit(at, geo, bot=False):
    return {"at": at, "geo": geo, "user_is_bot": bot}


@pytest.fixture(scope="module")
def log(make_log):
    one, two = "2024-01-01 10:00:00", "2024-01-02 10:00:00"
    return make_log(
        hit(one, "Iran (Islamic Republic of), Tehran"),
        hit(one, "Iran, Tehran"),  # parses like the one above
        hit(one, "Iran, Mashhad", True),
        hit(two, "France, Paris"),
        hit(two, "Singapore"),
        hit(two, "Nowhereland, Atlantis"),
        hit(two, "Antarctica, McMurdo"),
        hit(two, "-"),
        hit(two, ""),
        hit(two, None),
    )


@pytest.fixture(scope="module")
def dims(spark):
    return fixture.countries(spark), fixture.cities(spark)


def test_cube_merges_texts_that_parse_alike(log):
    found = tuples(geography.ordered_geo_cube(log))
    assert [(r[0], r[1], r[4]) for r in found[:1]] == [("Iran", "Tehran", 2)]
    assert len(found) == 6
    assert sum(r[4] for r in found) == 7


def test_country_lookup_keeps_rows(log, dims):
    found = geography.with_country_info(geography.geo_cube(log), dims[0])
    info = {r.country: (r.iso_alpha, r.continent) for r in found.collect()}
    assert info["Iran"] == ("IRN", "Asia")
    assert info["Antarctica"] == ("ATA", None)
    assert info["Nowhereland"] == (None, None)
    assert found.count() == 6


def test_levels(log, dims):
    cube = geography.geo_cube(log)

    def level(name, **kw):
        return sorted(tuples(region_view(cube, *dims, name, **kw)), key=repr)

    assert level("country") == [
        ("ATA", "Antarctica", 1), ("FRA", "France", 1), ("IRN", "Iran", 3), ("SGP", "Singapore", 1),
    ]
    assert level("continent") == [
        ("FRA", "Europe", "France", 1), ("IRN", "Asia", "Iran", 3), ("SGP", "Asia", "Singapore", 1),
    ]
    # Paris is listed twice, Mashhad and McMurdo are not listed
    assert [(r[0], r[1], r[2], r[5]) for r in level("city")] == [
        ("Mashhad", 1, None, 1.5), ("McMurdo", 1, None, 1.5), ("Paris", 1, "France", 1.5),
        ("Paris", 1, "United States", 1.5), ("Tehran", 2, "Iran", 3.0),
    ]
    assert level("country", start="2024-01-01", end="2024-01-01", bots=[True]) == [("IRN", "Iran", 1)]
    assert level("country", bots=[]) == []
    with pytest.raises(ValueError):
        region_view(cube, *dims, "street")


def test_stored_cube(spark, log, dims, tmp_path):
    path = str(tmp_path / "cube")
    for _ in range(2):
        write_days(geography.geo_cube(log), path)
    stored = spark.read.parquet(path)
    assert sorted(tuples(region_view(stored, *dims, "country"))) == sorted(
        tuples(region_view(geography.geo_cube(log), *dims, "country"))
    )


def test_continent_totals(log, dims):
    found = tuples(geography.continent_totals(geography.located(geography.geo_cube(log), dims[0])))
    assert ("Asia", None, 4) in found and ("Europe", None, 1) in found
    assert len(found) == 5


def test_last_24_hours(log, dims):
    assert tuples(geography.country_counts_24h(log, dims[0])) == [
        ("Iran", 3, "IRN"), ("Antarctica", 1, "ATA"), ("France", 1, "FRA"), ("Singapore", 1, "SGP"),
    ]


def test_rollup_stands_in_for_the_log(log):
    small = rollup(log, "geo", "user_is_bot")
    assert sorted(tuples(geography.geo_cube(small)), key=repr) == sorted(
        tuples(geography.geo_cube(log)), key=repr
    )


def test_country_table_from_locale_data(spark):
    rows = {r.alias: (r.iso3, r.continent) for r in country_table(spark).collect()}
    assert len(rows) == country_table(spark).count()  # one row per alias
    for alias, expected in {
        "iran": ("IRN", "Asia"),
        "united states of america": ("USA", "North America"),
        "united states": ("USA", "North America"),
        "us": ("USA", "North America"),
        "korea, republic of": ("KOR", "Asia"),
        "south korea": ("KOR", "Asia"),
        "mexico": ("MEX", "North America"),
        "brazil": ("BRA", "South America"),
        "russian federation": ("RUS", "Europe"),
        "egypt": ("EGY", "Africa"),
        "australia": ("AUS", "Oceania"),
        "antarctica": ("ATA", None),
        "276": ("DEU", "Europe"),
        "deu": ("DEU", "Europe"),
    }.items():
        assert rows[alias] == expected
    assert "nowhereland" not in rows
    assert len({v[0] for v in rows.values()}) >= 249


def test_lookup_files(spark, tmp_path):
    cities = tmp_path / "cities.csv"
    cities.write_text(
        'city,city_ascii,lat,lng,country,population\n"Paris",Paris,48.9,2.4,France,1\nOslo,Oslo,,,Norway,2\n'
    )
    assert tuples(read_cities(spark, str(cities))) == [
        ("Paris", "France", 48.9, 2.4), ("Oslo", "Norway", None, None),
    ]
    countries = tmp_path / "countries.csv"
    countries.write_text("alias,iso3,continent\nIran,IRN,Asia\nAntarctica,ATA,\n")
    assert tuples(read_countries(spark, str(countries))) == [
        ("iran", "IRN", "Asia"), ("antarctica", "ATA", None),
    ]


def test_countries_match_by_code_or_by_their_own_name(spark):
    counts = spark.createDataFrame(
        [("Paris", "France", 1), ("Ashburn", "United States of America", 2), ("X", "Nowhere", 3), ("Y", None, 4)],
        "city string, country string, count long",
    )
    cities = spark.createDataFrame(
        [("Paris", "France", 1.0, 2.0), ("Paris", "United States", 3.0, 4.0), ("Ashburn", "United States", 5.0, 6.0),
         ("X", " nowhere", 7.0, 8.0), ("X", "Elsewhere", 9.0, 9.0), ("Y", None, 9.0, 9.0)],
        "city string, country string, lat double, lng double",
    )
    found = geography.geocoded(counts, cities, True, country_table(spark))
    assert sorted(tuples(found.select("city", "country", "lat"))) == [
        ("Ashburn", "United States of America", 5.0), ("Paris", "France", 1.0), ("X", "Nowhere", 7.0), ("Y", None, None),
    ]
    assert tuples(geography.geocoded(counts, cities, True).where("city = 'Ashburn'"))[0][3] is None
