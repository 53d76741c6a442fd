import pytest
from conftest import tuples
from pyspark.sql import functions as F

from accesslens.operators.search import search_columns, search_condition
from accesslens.plans.text_index import build_index, pruned_log
from accesslens.sources.readers import open_log
from accesslens.sources.writers import write_log

PERIOD = ("2024-01-01", "2024-01-31")
AGENTS = ["Mozilla Chrome/72", "Opera", "KKelvin", "", None, "ÉTÉ agent"]


@pytest.fixture(scope="module")
def stored(make_log, spark, tmp_path_factory):
    rows = [
        {
            "at": f"2024-01-{1 + k // 6:02d} 0{k % 6}:00:00",
            "ip": f"10.0.{k // 6}.{k % 6}" if k % 5 else None,
            "url": f"https://x.org/Page_{k // 12}/%20{k}",
            "geo": ["Iran, Tehran", "France, Paris", ""][k // 6 % 3],
            "user_agent": AGENTS[k // 6 % 6],
            "user_browser": "Firefox" if k == 40 else None,
        }
        for k in range(60)
    ]
    folder = str(tmp_path_factory.mktemp("with space") / "log")
    write_log(make_log(*rows), folder)
    index = folder + "-index"
    build_index(open_log(spark, folder)).write.parquet(index)
    return folder, index


def found(log, **terms):
    return sorted(tuples(search_columns(log.where(search_condition(log, *PERIOD, **terms)))), key=repr)


@pytest.mark.parametrize(
    "terms, files",
    [
        ({"ip": "10.0.3."}, 1),
        ({"ip": "0.7.%5"}, 1),  # the longest piece
        ({"geo": "IRAN"}, 4),
        ({"geo": "tehran", "url": "page_3"}, 4),  # _ is a wildcard too
        ({"url": "/%20"}, 10),  # % is a wildcard, the rest is too short
        ({"user_agent": "chrome"}, 2),
        ({"user_agent": "firefox"}, 1),
        ({"user_agent": "kkelvin"}, 2),  # the Kelvin sign in small letters
        ({"user_agent": "été"}, 10),  # not ASCII
        ({"user_agent": "op"}, 10),
        ({"url": "nowhere"}, 0),
        ({"ip": "1_.0", "geo": None}, 10),
        ({}, 10),
    ],
)
def test_same_rows_from_fewer_files(stored, spark, terms, files):
    folder, index = stored
    kept = pruned_log(spark, folder, spark.read.parquet(index), **terms)
    whole = open_log(spark, folder)
    assert whole.schema == kept.log.schema
    assert found(kept.log, **terms) == found(whole, **terms)
    # a filter of 16 KB may hold a trigram of other texts
    read = len(kept.log.inputFiles()) if files else kept.log.count()
    assert read == files
    assert ("not looked up" in kept.note) == (files == 10 and bool(terms))


def test_files_the_index_does_not_know_are_read(stored, spark, make_log, tmp_path):
    folder, index = stored
    copy = str(tmp_path / "log")
    write_log(open_log(spark, folder), copy)
    old = build_index(open_log(spark, copy).where("day < '2024-01-05'"))
    write_log(make_log({"at": "2024-01-20 01:00:00", "ip": "10.0.3.9"}), copy)
    kept = pruned_log(spark, copy, old, ip="10.0.3.")
    assert found(kept.log, ip="10.0.3.") == found(open_log(spark, copy), ip="10.0.3.")
    assert len(kept.log.inputFiles()) == 1 + 6 + 1
    assert build_index(open_log(spark, copy).where(F.lit(False))).count() == 0
