from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import Project, column_lineage, write_audit_publish
from tidemark.sources import bronze
from tidemark.sources.tables import Backfill, Catalog, CatalogError, MergeCardinality, NotFound, ReferenceConflict, SchemaChange
from tidemark.streaming import drain


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/lake")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge(spark, catalog):
    catalog.append("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    catalog.append("t", spark.createDataFrame([(3, "c")], "id int, v string"))
    kept = catalog.manifest("t")["files"][-1]["path"]
    catalog.merge("t", spark.createDataFrame([(2, "B"), (4, "d")], "id int, v string"), ["id"])
    assert rows(catalog.table("t")) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert kept in [f["path"] for f in catalog.manifest("t")["files"]]  # files without a key are not rewritten
    before = catalog.get_reference().hash
    assert catalog.merge("t", spark.createDataFrame([], "id int, v string"), ["id"]) is None and catalog.get_reference().hash == before
    with pytest.raises(MergeCardinality):
        catalog.merge("t", spark.createDataFrame([(9, "x"), (9, "y")], "id int, v string"), ["id"])
    with pytest.raises(SchemaChange):
        catalog.merge("t", spark.createDataFrame([(9, "x", 1)], "id int, v string, w int"), ["id"])
    assert catalog.files("t").agg(F.sum("record_count")).first()[0] == 4 and catalog.snapshots("t").count() == 4
    catalog.compact("t")
    assert rows(catalog.table("t")) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")] and catalog.files("t").count() == 1


def test_incremental_watermark_and_backfill(spark, catalog):
    at = lambda d: datetime(2024, 1, d)
    log = spark.createDataFrame([(1, "a", at(1)), (2, "b", at(2)), (3, "c", at(3))], "id int, v string, _ingested_at timestamp_ntz")
    catalog.incremental("t", log.where("id < 3"), ["id"])
    catalog.incremental("t", log.withColumn("v", F.upper("v")), ["id"])
    assert rows(catalog.table("t").select("id", "v")) == [(1, "a"), (2, "b"), (3, "C")]
    assert catalog.incremental("t", log, ["id"]) is None
    catalog.incremental("t", log.withColumn("v", F.lit("z")), ["id"], backfill=Backfill(at(2), at(3)))
    assert rows(catalog.table("t").select("id", "v")) == [(1, "a"), (2, "z"), (3, "C")]
    with pytest.raises(ValueError):
        Backfill(at(1), None, require_both=True).condition("x")


def test_evolution(spark, catalog):
    catalog.append("t", spark.createDataFrame([(1, "a", 2.0)], "id int, v string, w double"))
    catalog.alter_type("t", "id", "bigint")
    for column, kind in (("id", "int"), ("v", "int"), ("w", "float")):
        with pytest.raises(SchemaChange):
            catalog.alter_type("t", column, kind)
    catalog.rename_column("t", "v", "name")
    catalog.drop_column("t", "w")
    catalog.add_column("t", "w", "double", after="id")
    assert rows(catalog.table("t")) == [(1, None, "a")]  # a dropped column's id is never used again
    assert catalog.table("t").columns == ["id", "w", "name"]
    with pytest.raises(NotFound):
        catalog.rename_column("t", "v", "x")


def test_branches(spark, catalog):
    one = spark.createDataFrame([(1,)], "id int")
    catalog.append("a", one)
    catalog.append("b", one)
    old = catalog.get_reference()
    catalog.create_branch("dev")
    dev = catalog.at("dev")
    dev.append("a", one)
    catalog.append("b", one)
    assert (catalog.table("a").count(), dev.table("a").count()) == (1, 2)
    assert catalog.merge_branch("dev").was_applied and catalog.table("a").count() == 2 and catalog.table("b").count() == 2
    dev.append("b", one)
    catalog.append("b", one)
    with pytest.raises(ReferenceConflict):
        catalog.merge_branch("dev")
    past = catalog.at(f"main@{old.hash}")
    assert past.table("a").count() == 1
    with pytest.raises(CatalogError):
        past.append("a", one)
    with pytest.raises(ReferenceConflict):
        catalog.assign_reference("main", old.hash, old.hash)
    catalog.assign_reference("main", catalog.get_reference().hash, old.hash)
    assert catalog.table("b").count() == 1 and catalog.get_log(contains="append")[0]["hash"] == old.hash
    catalog.delete_reference("dev", dev.get_reference().hash)
    later = datetime.now() + timedelta(days=30)
    assert catalog.vacuum(now=later) == 4 and rows(catalog.table("a")) == [(1,)]


def test_failed_write_leaves_table(spark, catalog):
    catalog.append("t", spark.createDataFrame([(1,)], "id int"))
    broken = spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.lit(1)).alias("id"))
    with pytest.raises(Exception, match="killed"):
        catalog.overwrite("t", broken)
    assert rows(catalog.table("t")) == [(1,)]




def demo(spark):
    p = Project()
    source = spark.createDataFrame([(i, f"c{i}") for i in range(8)], "id int, code string")

    @p.model(layer="gold", takes_vars=True, tests={"not_null": lambda df: df.where("code is null")})
    def dim(variables):
        return source.unionByName(spark.createDataFrame([(99, None)], "id int, code string")) if variables.get("inject_bad_row") else source

    @p.model(("dim",), layer="gold", materialized="incremental", keys=("id",))
    def fact(d):
        return d.select("id")

    return p


def test_write_audit_publish(spark, catalog):
    p = demo(spark)
    assert write_audit_publish(p, catalog, "dim").exit_code == 0 and catalog.table("dim").count() == 8
    bad = write_audit_publish(p, catalog, "dim", {"inject_bad_row": True})
    assert bad.exit_code == 5 and catalog.table("dim").count() == 8 and catalog.at(bad.branch).table("dim").count() == 9
    assert write_audit_publish(p, catalog, "nothing").exit_code == 2
    with pytest.raises(TypeError):
        write_audit_publish(p, catalog, "dim", [1])


def test_project(spark, catalog):
    p = demo(spark)
    assert p.select("dim+") == ["dim", "fact"] and p.select("dim+,fact") == ["fact"] and p.lint() == []
    assert [r.status for r in p.build(catalog)] == ["ok", "ok"] and [r.status for r in p.build(catalog, variables={"inject_bad_row": True})] == ["failed", "skipped"]
    p.model(("bronze.x",), name="rogue", layer="gold")(lambda x: x)
    assert p.lint() == ["gold rogue reads bronze bronze.x"] and "dim --> fact" in p.graph()


def test_column_lineage(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3)], "k int, y int")
    out = a.join(b, "k").groupBy("k").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    got = column_lineage(out, a=a, b=b)
    assert got["xy"] == {"a.x", "b.y"} and got["k"] == {"a.k"}


def test_ingest(spark, catalog, tmp_path):
    schema = T.StructType.fromDDL("id long, n long, q string")
    spark.createDataFrame([(1, 1)], "id long, n int").coalesce(1).write.parquet(f"{tmp_path}/w1")
    spark.createDataFrame([(2, 2, "hd")], "id long, n long, q string").coalesce(1).write.parquet(f"{tmp_path}/w2")
    src = tmp_path / "src" / "e"
    src.mkdir(parents=True)
    for i in (1, 2):
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(src / f"part-0000{i}.parquet")
    root = f"{tmp_path}/src"
    assert bronze.ingest(catalog, root, {"e": schema}) == {"e": 2} and bronze.ingest(catalog, root, {"e": schema}) == {"e": 0}
    t = catalog.table("bronze.e")
    assert rows(t.select("id", "n", "q", "_source_file")) == [(1, 1, None, "e/part-00001.parquet"), (2, 2, "hd", "e/part-00002.parquet")]
    assert t.select("_batch_id", "_ingested_at").distinct().count() == 1
    import hashlib

    assert t.where("id = 1").first()._payload_hash == hashlib.md5(b"1||1").hexdigest()
    with pytest.raises(ValueError):
        bronze.ingest(catalog, root, {"e": schema}, ["nope"])
    assert bronze.ingest(catalog, root, {"none": schema}) == {"none": 0}


def test_streaming_drain(spark, catalog, tmp_path):
    schema = T.StructType.fromDDL("id long")
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/s")
    for _ in range(2):
        drain(catalog, f"{tmp_path}/s", schema, "bronze.s", f"{tmp_path}/ck")
    assert catalog.table("bronze.s").count() == 3


def test_one_key_touches_one_file(spark, catalog):
    """A merge of one key rewrites the one file that holds it, whatever the table's size; reads within bounds open only files that may match."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.overwrite("t", spark.range(1000).select("id", F.lit("a").alias("v")), keys=["id"])
        before = {f["path"] for f in catalog.manifest("t")["files"]}
        assert len(before) > 3
        catalog.merge("t", spark.createDataFrame([(500, "b")], "id long, v string"), ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    after = {f["path"] for f in catalog.manifest("t")["files"]}
    assert len(before - after) == 1 and catalog.table("t").count() == 1000 and catalog.table("t").where("v = 'b'").count() == 1
    near = catalog.table("t", {"id": (10, 12)})
    assert sorted(r.id for r in near.collect()) == [10, 11, 12] and len(near.inputFiles()) == 1
    assert {r.lower_bounds["id"] for r in catalog.files("t").collect()} >= {"0", "500"}


def test_replace_range(spark, catalog):
    days = lambda a, b, v: spark.range(a, b).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.lit(v).alias("v"))
    at = lambda n: date(2024, 1, 1 + n)
    catalog.overwrite("s", days(0, 20, "old"), keys=["d"])
    catalog.replace_range("s", days(17, 23, "new"), "d", at(17), at(22))
    catalog.replace_range("s", days(5, 7, "fix"), "d", at(5), at(8))  # days 7 and 8 have no rows any more
    got = {(r.d - date(2024, 1, 1)).days: r.v for r in catalog.table("s").collect()}
    assert got == {n: "new" if n >= 17 else "fix" if n in (5, 6) else "old" for n in range(23) if n not in (7, 8)}
    with pytest.raises(CatalogError):
        catalog.replace_range("s", days(0, 9, "far"), "d", at(5), at(8))


def test_watermark_by_commit_and_metadata_tables(spark, catalog):
    source = lambda *x: spark.createDataFrame([(k, v, datetime.fromisoformat(t)) for k, v, t in x], "k int, v string, _ingested_at timestamp_ntz")
    old, late = (1, "a", "2024-01-01T00:00:00"), (2, "b", "2999-01-01T00:00:00")
    catalog.incremental("t", source(old), ["k"], by_commit=True)
    assert catalog.committed_at("t") > "2024" and catalog.committed_at("none") is None
    assert catalog.incremental("t", source(old), ["k"], by_commit=True) is None
    catalog.incremental("t", source(old, late), ["k"], by_commit=True)
    assert catalog.table("t").count() == 2
    assert catalog.history("t").count() == catalog.manifests("t").count() == catalog.snapshots("t").count()
    assert catalog.manifests("t").orderBy(F.desc("record_count")).first().record_count == 2
    n = len(catalog.get_log())
    assert catalog.expire_snapshots(now=datetime(2999, 1, 1)) == n - 1 and len(catalog.get_log()) == 1 and catalog.table("t").count() == 2
