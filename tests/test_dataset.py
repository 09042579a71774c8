"""Datasets of 1,000 rows: 500 .txt, 400 .json, 100 without an extension."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest import Catalog, Mode
from palimpsest.errors import ConfigurationError, CorruptLog, DatasetError, EncryptionNotReady, ModeError, StoreClosed
from palimpsest.functions import extension

SCHEMA = "name string, directory string, length long, hash decimal(20,0), kind int"


def assets(spark, n=1000):
    i = F.col("id")
    ext = F.when(i < 500, ".txt").when(i < 900, ".json").otherwise("")
    return spark.range(0, n, 1, 3).select(F.concat(F.lpad(i.cast("string"), 4, "0"), ext).alias("name"), F.concat(F.lit("C:\\"), F.char(97 + (i / 100).cast("int"))).alias("directory"), F.lit(64).cast("long").alias("length"), F.lit(0).cast("decimal(20,0)").alias("hash"), F.when(i < 500, 1).when(i < 900, 2).otherwise(0).alias("kind"))


def make(spark, tmp_path, name="a", **how):
    catalog = Catalog(spark)
    c = catalog.configure(name, f"file://{tmp_path}/{name}", SCHEMA).derive("ext", extension("name")).index("name", "name").index("ext", extension("name")).index("id", "_id")
    for k, v in how.items():
        getattr(c, k)(v)
    c.register()
    return catalog


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    catalog = make(spark, tmp_path_factory.mktemp("a"))
    with catalog.open("A") as ds:
        assert ds.insert(assets(spark)) == (1, 1000)
        yield ds


def ids(df):
    return [r["_id"] for r in df.collect()]


def test_where_order_page(loaded):
    ds = loaded
    assert [ds.query().where(F.col("ext") == e).count() for e in (".txt", ".json", "")] == [500, 400, 100]
    assert ids(ds.query().order_by(F.desc("_id")).limit(1).to_df()) == [1000]
    assert ids(ds.query().skip(500).limit(3).to_df()) == [501, 502, 503]
    assert ds.query().skip(500).count() == 500 and ds.query().skip(1000).count() == 0 and ds.query().limit(0).count() == 0
    assert {r["kind"] for r in ds.query().skip(500).limit(400).to_df().collect()} == {2}
    names = [r["name"] for r in ds.query().order_by(F.desc("name")).to_df().collect()]
    assert names == sorted(names, reverse=True)
    with pytest.raises(RuntimeError):
        ds.query().where("true").where("true")
    with pytest.raises(ValueError):
        ds.query().skip(-1)


def test_aggregates(loaded):
    q = loaded.query
    assert q().sum("length") == 64000 and q().where("kind = 2").sum("length") == 25600 and q().skip(100).limit(100).sum("length") == 6400
    assert q().max("name") == "0999" and q().where("kind = 1").max("name") == "0499.txt" and q().skip(500).limit(400).max("name") == "0899.json"
    assert q().min("name") == "0000.txt" and q().min("length(ext)") == 0 and q().avg("length") == 64.0
    assert q().where("false").sum("length") == 0 and q().where("false").avg("length") == 0 and q().where("false").max("length") == 0
    assert q().where("false").max("length", null_on_empty=True) is None
    kinds = {"int": "int", "long": "bigint", "float": "float", "double": "double", "decimal(10,2)": "decimal(38,2)"}
    for of, to in kinds.items():
        assert q().aggregate("sum", F.col("length").cast(of)).dtypes == [("value", to)]
    assert q().sum(F.col("length").cast("float")) == 64000.0


def test_group_and_distinct(loaded):
    q = loaded.query
    assert [r[0] for r in q().select_distinct("length").collect()] == [64] and q().select_distinct("ext").count() == 3
    rows = q().group_by("ext").having(F.count("*") > 100).select(F.count("*").alias("n")).collect()
    assert sorted((r["ext"], r["n"]) for r in rows) == [(".json", 400), (".txt", 500)]
    # aggregates come after the page
    assert [tuple(r) for r in q().limit(10).group_by("ext").select(F.count("*").alias("n")).collect()] == [(".txt", 10)]
    last = q().group_by("ext").having(F.count("*") > 0).having(F.count("*") > 450)
    assert last.select(F.count("*").alias("n")).count() == 1


def test_index_predicates(loaded):
    v = lambda: loaded.via_index("name")
    n = "0500.json"
    assert [q.count() for q in (v().equal(n), v().not_equal(n), v().less(n), v().greater(n), v().less_equal(n), v().greater_equal(n), v().isin(n, n))] == [1, 999, 500, 499, 501, 500, 1]
    assert v().between("0100.txt", "0199.txt").count() == 100 and v().between("b", "a").count() == 0
    assert v().not_between("0100.txt", "0199.txt").count() == 900 and v().not_between("1", "0").count() == 1000
    assert loaded.via_index("ext").isin(".json", ".txt", ".x").count() == 900 and loaded.via_index("ext").isin(".x").count() == 0
    assert loaded.via_index("ext").equal(".json").where("name >= '0600.json'").count() == 300
    assert ids(v().greater_equal(n).order_by(F.desc("_id")).skip(100).limit(100).to_df()) == list(range(900, 800, -1))
    # the key is the default order
    assert ids(loaded.via_index("name").less("0003.txt").to_df()) == [1, 2, 3]
    with pytest.raises(KeyError):
        loaded.via_index("other")


def test_find(loaded):
    assert loaded.find("kind = 2")["_id"] == 501 and loaded.find(7)["name"] == "0006.txt" and loaded.find(5000) is None
    assert loaded.exists(3) and not loaded.exists("kind = 9") and loaded.count("kind = 0") == 100
    assert ids(loaded.find_ids(500, 100, 100, 9999)) == [100, 500]


def test_dml_versions_and_maintenance(spark, tmp_path):
    catalog = make(spark, tmp_path, archive_to=f"file://{tmp_path}/arch", snapshots_to=f"file://{tmp_path}/snap", index_identity=True, sized_by="20 + length(name)")
    with catalog.open("a") as ds:
        ds.insert(assets(spark))
        before = datetime.now(timezone.utc)
        time.sleep(0.05)
        assert ds.update("kind = 1", hash=F.col("hash") + 1) == 500
        assert ds.delete("kind = 0") == 100 and ds.count() == 900
        assert ids(ds.find_ids(500, 100, 501)) == [500, 100, 501]
        # updated rows moved to the end of the natural order
        assert ds.find("true")["_id"] == 501
        s = ds.statistics()
        assert (s["FreshCount"], s["StaleCount"], s["DeletedCount"], s["LastId"]) == (900, 500, 100, 1000)
        assert s["MaxDeletedSize"] == 24 and s["AvgFreshSize"] == pytest.approx((500 * 28 + 400 * 29) / 900)
        only = ds.statistics("FreshCount")
        assert only["FreshCount"] == 900 and only["StaleSize"] is None
        assert ds.query().order_by(F.desc("name")).limit(10).update(hash=F.lit(101)) == 10 and ds.count("hash = 101") == 10
        assert ds.query().order_by(F.desc("_id")).limit(100).delete() == 100 and ds.count() == 800
        assert ds.purge() == (510, 200) and ds.purge() == (0, 0)
        at = ds.snapshot()
        with pytest.raises(DatasetError):
            catalog.open("a")
    copy = catalog.snapshot_name("a", at)
    catalog.configure(copy, f"file://{tmp_path}/snap/{copy}", SCHEMA).register()
    with catalog.open(copy) as ds:
        assert ds.count() == 800 and ds.versions().where("_state <> 'Fresh'").count() == 0
        assert ds.insert(assets(spark, 1)) == (1001, 1001)
    assert catalog.defrag("a") == (510, 200) and catalog.defrag("a") == (0, 0)
    gone = catalog.read_archive("a")
    assert sorted((r["_state"], r["count"]) for r in gone.groupBy("_state").count().collect()) == [("Deleted", 200), ("Stale", 510)]
    assert catalog.restore("a", before, f"file://{tmp_path}/r") == 1000
    catalog.configure("r", f"file://{tmp_path}/r", SCHEMA).register()
    with catalog.open("r") as ds:
        assert sorted(ids(ds.rows())) == list(range(1, 1001)) and ds.count("hash = 0") == 1000
        assert ds.insert({"name": "x"}) == [1001]
    with catalog.open("a") as ds:
        assert ds.count() == 800 and ds.statistics()["StaleCount"] == 0
        assert ds.insert(assets(spark, 2)) == (1001, 1002)
    with pytest.raises(ValueError):
        catalog.restore("a", datetime.now(timezone.utc) + timedelta(hours=1), f"file://{tmp_path}/q")


def test_rows_buffer_and_modes(spark, tmp_path):
    catalog = make(spark, tmp_path, flush_interval=0)
    with catalog.open("a") as ds:
        seen = []
        assert ds.insert({"name": "x", "length": 5}, on_id=lambda i: seen.append(i) or {"hash": i}) == [1] and seen == [1]
        assert ds.insert([{"name": "y"}, {"name": "z"}]) == [2, 3]
        assert ds.find(1)["hash"] == 1 and ds.count() == 3
        with pytest.raises(EncryptionNotReady):
            ds.insert({"name": "s"}, encrypt=True)
    for mode, ok in ((Mode.READ_ONLY, False), (Mode.APPEND_ONLY, True)):
        c = Catalog(spark)
        c.configure("a", f"file://{tmp_path}/a", SCHEMA).set_mode(mode).register()
        with c.open("a") as ds:
            with pytest.raises(ModeError):
                ds.delete(1)
            if ok:
                assert ds.insert({"name": "w"}) == [4] and ds.count() == 4
                with pytest.raises(ModeError):
                    ds.query()
            else:
                assert ds.query().count() == 3
                with pytest.raises(ModeError):
                    ds.insert({"name": "w"})
    with pytest.raises(StoreClosed):
        ds.count()


def test_encryption(spark, tmp_path):
    for cipher in ("GCM", "CBC"):
        path = f"file://{tmp_path}/{cipher}"
        c = Catalog(spark)
        c.configure("e", path, SCHEMA).encrypt_with_password("long enough pw", cipher).register()
        with c.open("e") as ds:
            ds.insert(assets(spark, 10))
            ds.insert(assets(spark, 10), encrypt=True)
            assert ds.update("_id >= 11", hash=F.lit(3)) == 10
            assert ds.count() == 20 and ds.count("hash = 3 AND name like '000_.txt'") == 10
        c = Catalog(spark)
        c.configure("e", path, SCHEMA).register()
        with c.open("e") as ds:
            assert ds.query().count() == 10


def test_set_index(spark, tmp_path):
    c = Catalog(spark)
    c.configure("s", f"file://{tmp_path}/s", "a array<int>").set_index("a", "a").register()
    arrays = [[1, 2, 2], [3], [], [None, 5], None, [2, 9], [4, 4]]
    with c.open("s") as ds:
        ds.insert([{"a": a} for a in arrays])
        r = lambda: ds.via_set_index("a")
        clean = [[x for x in a or [] if x is not None] for a in arrays]
        want = lambda f: [k + 1 for k, a in enumerate(clean) if f(a)]
        some = lambda p: want(lambda a: any(map(p, a)))
        every = lambda p: want(lambda a: bool(a) and all(map(p, a)))
        cases = [
            (r().any_equal(2), some(lambda x: x == 2)), (r().any_in(3, 9), some(lambda x: x in (3, 9))), (r().any_in(), []), (r().any_not_equal(2), some(lambda x: x != 2)), (r().any_not_in(2, 9), some(lambda x: x not in (2, 9))),
            (r().all_not_equal(2), every(lambda x: x != 2)), (r().all_not_in(2, 3), every(lambda x: x not in (2, 3))), (r().all_not_in(), every(lambda x: True)),
            (r().any_greater(4), some(lambda x: x > 4)), (r().all_greater(2), every(lambda x: x > 2)), (r().any_less(3), some(lambda x: x < 3)), (r().all_less(5), every(lambda x: x < 5)),
            (r().any_greater_equal(5), some(lambda x: x >= 5)), (r().all_greater_equal(2), every(lambda x: x >= 2)), (r().any_less_equal(2), some(lambda x: x <= 2)), (r().all_less_equal(4), every(lambda x: x <= 4)),
        ]
        for q, expected in cases:
            assert ids(q.to_df()) == expected


def test_memory_and_configuration(spark, tmp_path):
    c = Catalog(spark)
    c.configure("m", schema=SCHEMA).index("ci", "name", collation="UNICODE_CI").register()
    with c.open("m") as ds:
        assert ds.insert([{"name": "Ab"}, {"name": "aB"}, {"name": "c"}]) == [1, 2, 3]
        assert ds.via_index("ci").equal("AB").count() == 2
        with pytest.raises(DatasetError):
            ds.flush()
    with c.open("m") as ds:
        assert ds.count() == 0
    p = f"file://{tmp_path}/x"
    bad = [
        lambda: c.configure("M").register(), lambda: c.configure("q").set_mode(Mode.READ_ONLY), lambda: c.configure("q").flush_interval(1), lambda: c.configure("q", p).flush_interval(61), lambda: c.configure("q", p).flush_interval(-1),
        lambda: c.configure("q").encrypt_with_key(b"x" * 32), lambda: c.configure("q", p).encrypt_with_key(b"short"), lambda: c.configure("q", p).encrypt_with_password("short"), lambda: c.configure("q", p).archive_to(p).archive_to(p),
        lambda: c.configure("q", p).set_mode(Mode.READ_ONLY).snapshots_to(p), lambda: c.configure("q", p).snapshots_to(p).set_mode(Mode.READ_ONLY), lambda: c.configure("q", p).flush_interval(7).set_mode(Mode.READ_ONLY), lambda: c.get("nope"),
    ]
    for f in bad:
        with pytest.raises(ConfigurationError):
            f()
    assert "M" in c and c.remove("M") and "m" not in c


def test_corrupt_log(spark, tmp_path):
    import shutil

    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        ds.insert(assets(spark, 10))
    shutil.rmtree(next((tmp_path / "a" / "gen-0").iterdir()))
    with pytest.raises(CorruptLog):
        catalog.open("a")


def test_streams(spark, tmp_path):
    from palimpsest.streaming import changes, insert_stream

    assets(spark, 30).write.parquet(f"file://{tmp_path}/in")
    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        for _ in range(2):  # the second run finds nothing new
            rows = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
            insert_stream(ds, rows, "feed", f"file://{tmp_path}/ck").awaitTermination()
        assert ds.count() == 30
        seen, at = changes(ds)
        assert seen.count() == 30 and at == 30
        ds.delete(7)
        seen, at = changes(ds, at)
        assert [(r["_id"], r["_op"]) for r in seen.collect()] == [(7, "D")] and at == 31
        assert changes(ds, at)[0].count() == 0


def test_conversion_and_codec(spark, tmp_path):
    c = Catalog(spark)
    config = c.configure("k", f"file://{tmp_path}/k", "name string, length long").convert("name", "upper(name)").encrypt_with_key(b"k" * 32)
    kind = "struct<name:string,length:bigint>"
    config.serialize_with(lambda v: F.to_csv(v).cast("binary"), lambda b, schema: F.from_csv(b.cast("string"), kind[7:-1].replace(":", " "))).register()
    with c.open("k") as ds:
        ds.insert(spark.createDataFrame([("a", 1)], "name string, length long"), encrypt=True)
        ds.insert({"name": "b", "length": 2})
        assert [(r["name"], r["length"]) for r in ds.query().to_df().collect()] == [("A", 1), ("B", 2)]
        assert ds.statistics("MinFreshSize", "MaxFreshSize")["MaxFreshSize"] == 3 + 28


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def failing(log, times=1):
    """The log's next commits fail after their files were written."""
    real, left = log.commit, [times]

    def commit(meta):
        if left[0]:
            left[0] -= 1
            raise OSError("the store is away")
        real(meta)

    log.commit = commit


def test_stream_batch_survives_a_failed_write(spark, tmp_path):
    from palimpsest.streaming import insert_stream

    assets(spark, 5).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        ds.insert({"name": "buffered"})
        for bad in (True, False):
            if bad:
                ds.flush()
                failing(ds._log)
            rows = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
            q = insert_stream(ds, rows, "feed", f"file://{tmp_path}/ck")
            if bad:
                with pytest.raises(Exception):
                    q.awaitTermination()
                assert ds.count() == 1 and ds._log.meta.streams == {}
            else:
                q.awaitTermination()
        assert ds.count() == 6 and ds._log.meta.streams == {"feed": 0}
        ds._insert_batch(assets(spark, 5), "feed", 0)  # the replay of a committed batch
        assert ds.count() == 6


def test_updates_are_atomic(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        ds.insert([{"name": "x", "length": 0}, {"name": "y", "length": 0}])
        with ThreadPoolExecutor(6) as pool:
            assert list(pool.map(lambda _: ds.update(1, length=F.col("length") + 1), range(6))) == [1] * 6
        assert ds.find(1)["length"] == 6
        # A query sees the rows of the moment of its terminal: a deleted row doesn't come back.
        q, later = ds.query().where("_id = 1"), ds.query().where("_id = 2")
        assert ds.delete(1) and q.update(length=9) == 0 and not ds.exists(1)
        assert ds.update(2, length=5) == 1 and later.to_df().head()["length"] == 5


def test_archive_after_a_crash(spark, tmp_path):
    catalog = make(spark, tmp_path, archive_to=f"file://{tmp_path}/arch")
    with catalog.open("a") as ds:
        ds.insert(assets(spark, 20))
        at = datetime.now(timezone.utc)
        time.sleep(0.05)
        ds.update("true", length=F.lit(1).cast("long"))
    from palimpsest.sources.log import LogStore

    real = LogStore.rewrite
    LogStore.rewrite = lambda *a: (_ for _ in ()).throw(OSError("crash"))
    try:
        with pytest.raises(OSError):
            catalog.defrag("a")
    finally:
        LogStore.rewrite = real
    assert catalog.restore("a", at, f"file://{tmp_path}/r0") == 20
    assert catalog.defrag("a") == (20, 0) and catalog.read_archive("a").count() == 20
    assert catalog.restore("a", at, f"file://{tmp_path}/r1") == 20
    with catalog.open("a") as ds:
        ds.update("_id <= 5", length=F.lit(2).cast("long"))
    assert catalog.defrag("a") == (5, 0) and catalog.read_archive("a").count() == 25


def test_wrong_key_and_hidden_key(spark, tmp_path):
    for cipher in ("GCM", "CBC"):
        path = f"file://{tmp_path}/{cipher}"
        c = Catalog(spark)
        c.configure("e", path, SCHEMA).encrypt_with_key(b"k" * 32, cipher).register()
        with c.open("e") as ds:
            ds.insert(assets(spark, 10))
            ds.insert(assets(spark, 600), encrypt=True)
            ds.insert({}, encrypt=True)  # a row of nulls is a row
            assert ds.count() == ds.query().count() == 611
            for text in (ds.rows()._jdf.queryExecution().toString(),):
                assert "k" * 32 not in text and "6b6b6b6b" not in text.lower()
        for key in (b"w" * 32, None):
            c = Catalog(spark)
            config = c.configure("e", path, SCHEMA)
            if key:
                config.encrypt_with_key(key, cipher)
            config.register()
            with c.open("e") as ds:
                assert ds.query().count() == ds.count() == 10


def test_torn_state_and_orphans(spark, tmp_path):
    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        ds.insert(assets(spark, 10))
        failing(ds._log)
        with pytest.raises(OSError):
            ds.insert(assets(spark, 5))
    (tmp_path / "a" / "_meta" / f"{9:012d}.json").write_text("")
    (tmp_path / "a" / "_stage-left").mkdir()
    with catalog.open("a") as ds:
        assert ds.count() == 10 and ds.insert(assets(spark, 5)) == (11, 15)
    assert not (tmp_path / "a" / "_stage-left").exists() and len(list((tmp_path / "a" / "gen-0").iterdir())) == 2
    with catalog.open("a") as ds:
        assert ds.count() == ds.query().count() == 15


def test_lock_of_a_dead_process(spark, tmp_path):
    import json
    import platform

    catalog = make(spark, tmp_path)
    lock = tmp_path / "a" / "_lock"
    with catalog.open("a") as ds:
        ds.insert(assets(spark, 3))
        other = make(spark, tmp_path)
        with pytest.raises(DatasetError):
            other.open("a")
    lock.write_text(json.dumps({"host": platform.node(), "pid": 2**22 + 7, "began": "1"}))
    with catalog.open("a") as ds:
        assert ds.count() == 3
    lock.write_text(json.dumps({"host": "another", "pid": 1, "began": "1"}))
    with pytest.raises(DatasetError):
        catalog.open("a")
    catalog.unlock("a")
    catalog.open("a").close()
    assert not lock.exists()


def test_timer_and_halt(spark, tmp_path):
    catalog = make(spark, tmp_path, flush_interval=1)
    with catalog.open("a") as ds:
        ds.insert([{"name": "x"}, {"name": "y"}])
        assert ds._log.meta.rows == 0
        until = time.time() + 30
        while ds._log.meta.rows != 2 and time.time() < until:
            time.sleep(0.2)
        assert ds._log.meta.rows == 2
        seen = []
        ds.on_halted = seen.append
        failing(ds._log)
        ds.insert({"name": "z"})
        while not seen and time.time() < until:
            time.sleep(0.2)
        assert isinstance(seen[0], OSError)
        with pytest.raises(StoreClosed):
            ds.count()
    with catalog.open("a") as ds:
        assert ds.count() == 2


def test_plan_of_a_changed_log(spark, tmp_path):
    """Rows that never changed are scanned with filters and columns pruned, and not shuffled."""
    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        ds.insert(assets(spark))
        ds.update("kind = 1 AND _id <= 10", hash=F.lit(1))
        ds.delete("_id = 1000")
        df = ds.query().where("length = 64 AND kind = 2").select("name", ordered=False)
        text = plan_of(df)
        assert df.count() == 400 and ds.count() == 999
        scan = next(x for x in text.split("\n") if "FileScan" in x)  # of the inserts
        assert "EqualTo(length,64)" in scan and "EqualTo(kind," in text and "directory" not in scan and "_payload" not in scan
        above = text[: text.index("FileScan")]
        assert "Exchange" not in above and "BroadcastHashJoin" in above and "LeftAnti" in above and "SortAggregate" not in text


def test_skip_without_one_task(spark, tmp_path):
    catalog = make(spark, tmp_path)
    with catalog.open("a") as ds:
        ds.insert(assets(spark))
        df = ds.query().order_by(F.desc("name")).skip(300).to_df()
        assert "SinglePartition" not in plan_of(df) and "GlobalLimit" not in plan_of(df)
        names = [r["name"] for r in df.collect()]
        assert names == sorted((r["name"] for r in ds.rows().collect()), reverse=True)[300:]
        assert [ds.query().skip(n).sum("length") for n in (0, 1, 999, 1000, 5000)] == [64000, 63936, 64, 0, 0]
        assert ds.query().skip(990).limit(20).count() == 10 and ds.query().skip(5000).count() == 0
        assert ds.query().skip(995).delete() == 5 and ds.count() == 995
