import csv
import gzip
import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerband.operators.contracts import ContractError
from peerband.plans.build import build_market
from peerband.sources import curated, raw
from tests.conftest import CALENDAR_ROWS, CALENDAR_SCHEMA, RAW_COLUMNS, RAW_ROWS


def dump(folder, name, columns, rows):
    path = folder / f"{name}.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        writer.writerows(["" if v is None else v for v in r] for r in rows)
    return path


@pytest.fixture
def raw_dir(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    dump(folder, "listings", RAW_COLUMNS, RAW_ROWS)
    dump(folder, "calendar", [c.split()[0] for c in CALENDAR_SCHEMA.split(", ")], CALENDAR_ROWS)
    return folder


def test_build_writes_tables_and_manifest(spark, raw_dir, tmp_path):
    market = build_market(spark, str(raw_dir), str(tmp_path / "a"), "2026-03-31")
    row = market.manifest.first()
    assert row["snapshot_date"] == "2026-03-31" and row["n_listings"] == 3
    assert row["n_seasonality_detrended_rows"] == 7 and row["n_seasonality_rows"] == 14
    assert row["has_estimated_occupancy"] is False and row["generated_at"]
    for name in ("listings.csv.gz", "calendar.csv.gz"):
        body = (raw_dir / name).read_bytes()
        entry = row["raw_files"][name]
        assert entry["sha256"] == hashlib.sha256(body).hexdigest() and entry["bytes"] == len(body)
    tables = curated.read_curated(spark, str(tmp_path / "a"))
    assert {n: t.count() for n, t in tables.items()} == {
        "listings": 3, "calendar_seasonality": 14, "calendar_seasonality_detrended": 7,
        "occupancy": 3}
    again = build_market(spark, str(raw_dir), str(tmp_path / "b"), "2026-03-31")
    for name, table in again.tables.items():
        assert table.schema == tables[name].schema
        assert table.exceptAll(tables[name]).isEmpty() and tables[name].exceptAll(table).isEmpty()


def test_failed_contract_publishes_nothing(spark, raw_dir, tmp_path):
    dump(raw_dir, "listings", RAW_COLUMNS, [RAW_ROWS[0], RAW_ROWS[0]])
    with pytest.raises(ContractError, match="unique listing_id"):
        build_market(spark, str(raw_dir), str(tmp_path / "out"), "2026-03-31")
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError):
        build_market(spark, str(raw_dir), str(tmp_path / "out"), "31/03/2026")


def test_failed_fingerprint_publishes_nothing_and_keeps_the_last_build(
        spark, raw_dir, tmp_path, monkeypatch):
    from peerband.plans import build

    out = tmp_path / "out"
    build_market(spark, str(raw_dir), str(out), "2026-03-31")
    before = {p: p.read_bytes() for p in sorted(out.rglob("*")) if p.is_file()}

    def broken(session, paths):
        return session.range(1).select(F.raise_error(F.lit("unreadable dump")).alias("file"))

    monkeypatch.setattr(build.raw, "fingerprints", broken)
    with pytest.raises(PySparkException, match="unreadable dump"):
        build_market(spark, str(raw_dir), str(out), "2026-04-30")
    assert before == {p: p.read_bytes() for p in sorted(out.rglob("*")) if p.is_file()}
    with pytest.raises(PySparkException, match="unreadable dump"):
        build_market(spark, str(raw_dir), str(tmp_path / "new"), "2026-04-30")
    assert not (tmp_path / "new").exists()


STEPS = ("write", "replace", "names", "delete")


@pytest.mark.parametrize("stop", STEPS)
def test_a_build_that_stops_anywhere_leaves_one_whole_build(
        spark, raw_dir, tmp_path, monkeypatch, stop):
    """The third of three builds dies at a file system call and cannot even clean up."""
    out = str(tmp_path / "out")
    for day in ("2026-03-31", "2026-04-01"):
        build_market(spark, str(raw_dir), out, day)

    def die(self, *_):
        raise KeyboardInterrupt(stop)

    def snapshots():
        row = curated.read_manifest(spark, out).first()
        rows = {n: t.count() for n, t in curated.read_curated(spark, out).items()}
        horizon = curated.read_curated(spark, out)["calendar_seasonality_detrended"].agg(
            F.min(F.expr("date_sub(date, cast(horizon_days as int))"))).first()[0]
        return row["snapshot_date"], str(horizon), rows

    whole = snapshots()
    dump(raw_dir, "listings", RAW_COLUMNS, RAW_ROWS[:1])
    with monkeypatch.context() as m:
        m.setattr(curated.OutputFolder, stop, die)
        m.setattr(curated.Build, "clear", lambda self: None)
        with pytest.raises(KeyboardInterrupt):
            build_market(spark, str(raw_dir), out, "2026-05-05")
    day, horizon, rows = snapshots()
    if stop in ("write", "replace"):
        assert (day, horizon, rows) == whole and day == "2026-04-01"
    else:
        assert day == horizon == "2026-05-05" and rows["listings"] == rows["occupancy"] == 1
    again = build_market(spark, str(raw_dir), out, "2026-06-06")
    assert again.manifest.first()["n_listings"] == 1
    kept = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("build-")]
    assert len(kept) == curated.KEPT_BUILDS


def test_readers_of_the_build_before_are_not_disturbed(spark, raw_dir, tmp_path):
    out = str(tmp_path / "out")
    before = build_market(spark, str(raw_dir), out, "2026-03-31").tables["listings"]
    dump(raw_dir, "listings", RAW_COLUMNS, RAW_ROWS[:1])
    after = build_market(spark, str(raw_dir), out, "2026-04-01").tables["listings"]
    assert before.count() == 3 and after.count() == 1
    with pytest.raises(FileNotFoundError):
        curated.read_curated(spark, str(tmp_path / "none"))


def test_rules_are_counted_by_the_write(spark, tmp_path, monkeypatch):
    """Only keys are read after the write: nothing else asks the written table."""
    from peerband.operators import contracts

    rows = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 1.0)], "listing_id long, o double")
    rows = rows.withColumnRenamed("o", "occupancy_est")
    written, n = contracts.write_checked(rows, contracts.OCCUPANCY, str(tmp_path / "good"))
    assert n == 3 and written.count() == 3
    keys = contracts.repeated_keys(written, contracts.OCCUPANCY)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<listing_id:bigint>" in plan
    bad = rows.withColumn("occupancy_est", F.col("occupancy_est") * 2)
    with pytest.raises(ContractError, match="2 row.*occupancy_est <= 1"):
        contracts.write_checked(
            bad.withColumn("occupancy_est", F.greatest("occupancy_est", F.lit(0.9))
                           * F.when(F.col("listing_id") == 2, 1).otherwise(2)),
            contracts.OCCUPANCY, str(tmp_path / "bad"))
    with pytest.raises(ContractError, match="unique"):
        contracts.write_checked(rows.union(rows), contracts.OCCUPANCY, str(tmp_path / "twice"))
    empty, n = contracts.write_checked(
        rows.where("false"), contracts.OCCUPANCY, str(tmp_path / "empty"))
    assert n == 0 and empty.count() == 0


@pytest.mark.parametrize("uri,want", [
    ("s3a://bucket/a b/c.csv.gz", ("s3://bucket/a%20b/c.csv.gz", False)),
    ("s3n://bucket/x", ("s3://bucket/x", False)),
    ("file:/tmp/é%.bin", ("file:///tmp/%C3%A9%25.bin", False)),
    ("file:///tmp/x", ("file:///tmp/x", False)),
    ("gs://bucket/x", ("gs://bucket/x", False)),
    ("abfss://box@account.dfs.core.windows.net/x",
     ("abfss://box@account.dfs.core.windows.net/x", False)),
    ("hdfs://name:8020/x y", ("hdfs://name:8020/x%20y", True)),
    ("viewfs://cluster/x", ("viewfs://cluster/x", True)),
    ("oci://bucket@space/x", ("oci://bucket@space/x", True)),
])
def test_places_for_arrow(uri, want):
    assert raw.arrow_place(uri) == want


def test_arrow_knows_the_native_schemes():
    from pyarrow.fs import FileSystem, S3FileSystem

    system, place = FileSystem.from_uri(
        raw.arrow_place("s3a://bucket/a b/c")[0] + "?region=nowhere&allow_bucket_creation=false")
    assert isinstance(system, S3FileSystem) and place == "bucket/a b/c"


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_fingerprints_read_in_chunks(spark, tmp_path, chunk):
    bodies = {"a b.bin": bytes(range(256)) * 3, "empty.bin": b"", "é%.bin": b"x" * 20}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r["file"]: (r["sha256"], r["bytes"])
           for r in raw.fingerprints(spark, f"{tmp_path}/*.bin", chunk).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items()}


def test_csv_stays_text_and_keeps_extra_columns(spark, tmp_path):
    path = dump(tmp_path, "x", ["id", "price", "estimated_occupancy_l365d", "note"],
                [["1", "$10.00", "200", 'two\nlines, "quoted"'], ["02", "", "3", "é"]])
    assert raw.load_csv(spark, str(path), "raw_x") == 2
    table = raw.raw_table(spark, "raw_x")
    assert set(dict(table.dtypes).values()) == {"string"}
    rows = {r["id"]: r for r in table.collect()}
    assert rows["1"]["note"] == 'two\nlines, "quoted"' and rows["02"]["price"] is None
    assert raw.load_csv(spark, str(path), "raw_x", store=str(tmp_path / "store")) == 2


def test_malformed_rows_fail(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        raw.read_text_csv(spark, str(path)).collect()


@pytest.mark.parametrize("name", ["raw; DROP TABLE x", "1x", "", "a b", "x\n"])
def test_bad_names(spark, tmp_path, name):
    with pytest.raises(ValueError):
        raw.load_csv(spark, str(tmp_path / "none.csv"), name)


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def quoted_rows(seed, rows):
    rng = random.Random(seed)
    bits = ["a", "line one\nline two", 'he said "no"', ",", "\n\n", "", "é", "x" * 150, '"', "'",
            "a\r\nb", " spaced ", "1,5", '"\n"']
    return [[str(i), rng.choice(bits) + rng.choice(bits), rng.choice(bits)] for i in range(rows)]


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_split_csv_equals_whole_files(spark, tmp_path, small_blocks, seed, end):
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["id", "first text", "b`c"])
            writer.writerows(quoted_rows(seed * 10 + part, 80))
            out.write(end if part else "")
    path = str(tmp_path / "*.csv")
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got, want = raw.read_split_csv(spark, path), raw.read_text_csv(spark, path)
    assert got.columns == want.columns and set(dict(got.dtypes).values()) == {"string"}
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 160


def test_split_csv_refuses_what_the_whole_read_refuses(spark, tmp_path, small_blocks):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with pytest.raises(ValueError, match="does not end"):
        raw.read_split_csv(spark, file("open.csv", 'a,b\n1,"2\n3,4\n'))
    with pytest.raises(ValueError, match="no header"):
        raw.read_split_csv(spark, file("empty.csv", ""))
    with pytest.raises(Exception, match="[Mm]alformed"):
        raw.read_split_csv(spark, file("wide.csv", "a,b\n1,2\n1,2,3\n")).collect()
    file("other.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        raw.read_split_csv(spark, [str(tmp_path / "other.csv"), file("one.csv", "a,b\n1,2\n")])
    only = raw.read_split_csv(spark, file("only.csv", "a,b\n"))
    assert only.columns == ["a", "b"] and only.count() == 0


def test_plain_dumps_are_landed_in_blocks(spark, tmp_path, small_blocks):
    with open(tmp_path / "plain.csv", "w", newline="") as out:
        csv.writer(out).writerows([["id", "note"], *[[i, f"two\nlines {i}"] for i in range(40)]])
    assert raw.load_csv(spark, str(tmp_path / "plain.csv"), "plain_dump") == 40
    notes = {r["id"]: r["note"] for r in raw.raw_table(spark, "plain_dump").collect()}
    assert notes == {str(i): f"two\nlines {i}" for i in range(40)}
