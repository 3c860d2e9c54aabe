"""Reference CSV files read back with the declared schemas."""

import os

from phaselens.plans import sql_variants
from phaselens.sources.bindings import Model
from phaselens.sources.readers import read_reference_csv
from phaselens.sources.schemas import REFERENCE_TABLES
from phaselens.sources.sinks import write_result


def test_reference_csv_round_trip(spark, ref_model, tmp_path):
    # write the fixture as the reference ships it: header CSV files, pandas-style text
    for name, df in {"fact_orders": ref_model.orders_full, "fact_order_items": ref_model.order_items,
                     "fact_ratings": ref_model.ratings, "fact_delivery": ref_model.delivery,
                     "dim_customer": ref_model.customers, "dim_restaurant": ref_model.restaurants,
                     "dim_delivery_partner": ref_model.partners, "dim_menu_item": ref_model.menu}.items():
        fname = REFERENCE_TABLES[name][0]
        df.toPandas().to_csv(os.path.join(tmp_path, fname), index=False)
    assert os.path.exists(os.path.join(tmp_path, "dim_delivery_partner_.csv"))
    tables = read_reference_csv(spark, str(tmp_path))
    assert sorted(map(tuple, tables["fact_orders"].collect()), key=str) == \
        sorted(map(tuple, ref_model.orders_full.collect()), key=str)
    m = Model.from_reference(tables)
    for q in (sql_variants.s01_monthly_orders, sql_variants.s02_phase_revenue, sql_variants.s10_recovery_scorecard):
        assert sorted(map(tuple, q(m).collect()), key=str) == sorted(map(tuple, q(ref_model).collect()), key=str)


def test_write_result_partitioned(spark, ref_model, tmp_path):
    out = str(tmp_path / "trend")
    write_result(sql_variants.s01_monthly_orders(ref_model), out, partition_by=["business_phase"])
    back = spark.read.parquet(out)
    assert back.count() == sql_variants.s01_monthly_orders(ref_model).count()
    assert set(os.listdir(out)) >= {"business_phase=Crisis", "business_phase=Pre-Crisis"}


def test_run_reference_script_on_csv(spark, ref_model, tmp_path):
    import importlib.util
    csv_dir = tmp_path / "csv"
    csv_dir.mkdir()
    for name, df in {"fact_orders": ref_model.orders_full, "fact_order_items": ref_model.order_items,
                     "fact_ratings": ref_model.ratings, "fact_delivery": ref_model.delivery,
                     "dim_customer": ref_model.customers, "dim_restaurant": ref_model.restaurants,
                     "dim_delivery_partner": ref_model.partners, "dim_menu_item": ref_model.menu}.items():
        df.toPandas().to_csv(os.path.join(csv_dir, REFERENCE_TABLES[name][0]), index=False)
    spec = importlib.util.spec_from_file_location(
        "run_reference", os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts", "run_reference.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    names = ["s04_restaurant_decline", "p07_negative_keywords", "r05_segments"]
    assert mod.run(spark, str(csv_dir), str(tmp_path / "out"), names) == names
    back = spark.read.parquet(str(tmp_path / "out" / "p07_negative_keywords"))
    assert {r.keyword: r.frequency for r in back.collect()} == {"cold": 2, "late": 2, "stale": 3}


def test_materialize_writes_under_the_session_checkpoint_dir(spark):
    from phaselens.session import ensure_checkpoint_dir, materialize
    root = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == root  # read, never replaced
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    m = materialize(df, "unit")
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, df.collect()))
    files = m.inputFiles()
    assert files and all(f.startswith(root) or root.split(":", 1)[-1] in f for f in files)


def test_release_deletes_what_was_materialized(spark):
    from phaselens.session import discard, ensure_checkpoint_dir, materialize, release
    kept, gone = (materialize(spark.range(5).toDF("id"), name) for name in ("kept", "gone"))
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    discard(gone)
    left = os.listdir(os.path.join(root, "phaselens"))
    assert any(f.startswith("kept-") for f in left) and not any(f.startswith("gone-") for f in left)
    assert kept.count() == 5
    release(spark)
    assert not os.path.exists(os.path.join(root, "phaselens"))


def test_a_cluster_must_name_its_checkpoint_folder():
    import pytest

    from phaselens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_review_texts_with_quotes_commas_and_line_breaks(spark, ref_model, tmp_path):
    import csv

    from phaselens.plans.notebook_variants import p07_negative_keywords
    texts = ['he said "cold", then left', "late,\nlate and\r\nwrong", 'a ""doubled"" stale, one']
    rows = [tuple(r) for r in ref_model.ratings.collect()]
    with open(tmp_path / "fact_ratings.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(ref_model.ratings.columns)
        at = ref_model.ratings.columns.index("review_text")
        for i, r in enumerate(rows):
            out.writerow(["" if v is None else texts[i % 3] if j == at else v for j, v in enumerate(r)])
    tables = read_reference_csv(spark, str(tmp_path), ["fact_ratings"])
    got = sorted(r["review_text"] for r in tables["fact_ratings"].collect() if r["review_text"])
    # Spark's CSV reader hands every line break inside a field out as one character
    texts = [t.replace("\r\n", "\n") for t in texts]
    assert got == sorted(texts[i % 3] for i, r in enumerate(rows) if r[at] is not None)
    m = Model({"orders": ref_model.orders, "ratings": tables["fact_ratings"]}, ref_model.calendar, ref_model.params)
    assert {r["keyword"] for r in p07_negative_keywords(m).collect()} <= {"cold", "late", "wrong", "stale"}
    assert p07_negative_keywords(m).count() > 0
