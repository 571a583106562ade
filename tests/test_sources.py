from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomlog.errors import MalformedResponseError, SchemaDiscoveryError
from loomlog.operators import contract as K
from loomlog.operators import materialize as M
from loomlog.operators import snapshot as S
from loomlog.operators import validate as V
from loomlog.sources.app_table import AppTable
from loomlog.sources.checkpoints import StateCheckpoints

LOG = "stream_id string, sequence long, op string, table_name string, pk string, v int"


def a_log(spark):
    rows = [("s", n, "deleteRow" if n % 7 == 3 else "putRow", "t", f"[{n * n % 11}]", n) for n in range(1, 96)]
    rows += [("short", n, "putRow" if n % 5 else "deleteRow", "t", f"[{n % 4}]", n) for n in range(1, 24)]
    return spark.createDataFrame(rows, LOG)


def rows_of(df):
    return sorted(map(tuple, df.select("stream_id", "pk", "sequence", "v").collect()))


def test_state_as_of_from_checkpoints(spark, tmp_path):
    log = a_log(spark)
    at_once = StateCheckpoints(spark, str(tmp_path / "all"), log.schema, 10)
    at_once.write(log)
    by_parts = StateCheckpoints(spark, str(tmp_path / "parts"), log.schema, 10)
    for part in [*range(10), 4]:  # the fifth again, as after a failure
        by_parts.extend(log.where(f"sequence > {part * 10} and sequence <= {part * 10 + 10}"), part)
    for sequence in (3, 10, 19, 20, 23, 40, 57, 95, 99):
        want = rows_of(M.state(log, sequence))
        assert rows_of(at_once.at(sequence)) == want and rows_of(by_parts.at(sequence)) == want, sequence
    files = at_once.at(57).select(F.input_file_name().alias("f")).distinct().collect()
    assert {p for r in files for p in r.f.split("/") if "=" in p} <= {"at=5", "part=5", "part=2", "at=2"}


def test_states_kept_at_once_hold_a_row_once(spark, tmp_path):
    rows = [("s", n, "deleteRow" if n % 41 == 3 else "putRow", "t", f"[{n if n < 200 else n % 7}]", n) for n in range(1, 641)]
    log = spark.createDataFrame(rows, LOG)
    kept = StateCheckpoints(spark, str(tmp_path / "all"), log.schema, 4)
    kept.write(log)
    held = [spark.read.parquet(str(f)).count() for f in Path(tmp_path / "all").rglob("*.parquet") if "log" not in f.parent.parts[-1]]
    assert 0 < sum(held) <= len(rows) and len(held) < 20
    for sequence in (127, 128, 257, 512, 639, 700):
        assert rows_of(kept.at(sequence)) == rows_of(M.state(log, sequence)), sequence


def test_states_extended_after_all_at_once(spark, tmp_path):
    log = a_log(spark)
    kept = StateCheckpoints(spark, str(tmp_path / "both"), log.schema, 10)
    kept.write(log.where("sequence <= 44"))
    for part in range(4, 10):
        kept.extend(log.where(f"sequence > {part * 10} and sequence <= {part * 10 + 10}"), part)
    for sequence in (23, 44, 57, 99):
        assert rows_of(kept.at(sequence)) == rows_of(M.state(log, sequence)), sequence
    kept.write(log.where("sequence <= 57"))
    assert rows_of(kept.at(99)) == rows_of(M.state(log, 57))


def test_projection_rewrites_touched_buckets_only(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "'old' AS a", "cast(null AS string) AS b")
    log = spark.createDataFrame([("s", 1, "putRow", 3, "x", "y"), ("s", 2, "deleteRow", 5, None, None), ("s", 3, "putRow", 3, "z", None), ("t", 1, "putRow", 77, "n", "m")], "stream_id string, sequence long, op string, id long, a string, b string")
    table = AppTable(spark, str(tmp_path / "t"), rows.schema, ["id"], 8)
    table.create(rows)

    def files():
        return {(p.parent.name, p.name) for p in Path(tmp_path / "t" / "rows").rglob("*.parquet")}

    before = files()
    assert 1 <= table.apply(log) <= 3
    after = files()
    want = sorted(map(tuple, M.project(rows, log, ["id"], ["a", "b"]).collect()), key=str)
    assert sorted(map(tuple, table.read().collect()), key=str) == want
    assert len(before & after) >= 5
    assert table.apply(log) == 0 and files() == after
    assert table.apply(log.limit(0)) == 0
    everything = spark.range(40).selectExpr("'s' AS stream_id", "id + 4 AS sequence", "'deleteRow' AS op", "id", "cast(null AS string) AS a", "cast(null AS string) AS b")
    table.apply(log.unionByName(everything))
    assert [r.id for r in table.read().collect()] == [77]


def test_contract_from_spark_catalogue(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop LOCATION '" + str(tmp_path / "shop") + "'")
    try:
        spark.sql("CREATE TABLE shop.members (team BIGINT, user BIGINT, role STRING, score DOUBLE, blob BINARY, price DECIMAL(8,2)) USING parquet TBLPROPERTIES (primary_key = 'user, team')")
        spark.sql("CREATE TABLE shop.events (message STRING) USING parquet")
        spark.sql("CREATE TABLE shop.odd (a STRING) USING parquet TBLPROPERTIES (primary_key = 'b')")
        spark.sql("CREATE TABLE shop.internal_log (a STRING) USING parquet TBLPROPERTIES (primary_key = 'a')")
        found = K.from_spark_catalogue(spark, "shop", exclude=["events", "odd"], internal=["internal_"])
        assert list(found.tables) == ["members"] and found.tables["members"].primary_key == ("user", "team")
        columns = found.tables["members"].columns
        assert {c: x.affinity for c, x in columns.items()} == {"team": "integer", "user": "integer", "role": "text", "score": "real", "blob": "blob", "price": "numeric"}
        assert not columns["user"].nullable and columns["role"].nullable
        assert K.from_spark_catalogue(spark, "shop", ["members"]).schema_hash == found.schema_hash
        for include, why in ((["events"], "no primary key"), (["nowhere"], "no such tables"), (["odd"], "no column b")):
            with pytest.raises(SchemaDiscoveryError, match=why):
                K.from_spark_catalogue(spark, "shop", include)
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_density_and_repeats(spark, tmp_path):
    schema = "stream_id string, sequence long, operation_id string, client_id string, client_sequence long, intent_hash string, status string"
    good = [("s", n, f"o{n}", "c", n, "i", "accepted") for n in range(1, 40_001)]
    rows = lambda more: spark.createDataFrame(more, schema)
    assert V.density(rows(good)).count() == 0 and V.repeats(rows(good)).count() == 0
    assert [r.violation for r in V.density(rows(good[:100] + good[101:])).collect()] == ["missing"]
    assert [r.violation for r in V.density(rows([*good, good[7]])).collect()] == ["repeated"]
    assert [r.violation for r in V.density(rows([("s", 0, "o", "c", 1, "i", "accepted")])).collect()] == ["invalid-sequence"]
    log = rows(good[:50])
    odd = {"position": ("s", None, "x", "c", 3, "i", "rejected"), "id": ("s", None, "o3", "c", 99, "i", "rejected")}
    for name, row in odd.items():
        S.save(log, log.unionByName(rows([row])), str(tmp_path / name))
        with pytest.raises(MalformedResponseError, match="repeated"):
            S.load(spark, str(tmp_path / name))
    S.save(log, log, str(tmp_path / "good"))
    assert S.load(spark, str(tmp_path / "good"))[0].count() == 50


def test_typed_rows_and_empty_tables(spark):
    columns = {"id": K.ColumnContract("integer", False), "a b": K.ColumnContract("text", True), "x": K.ColumnContract("real", True), "n": K.ColumnContract("numeric", True), "raw": K.ColumnContract("blob", True)}
    contract = K.Contract({"t": K.TableContract(("id",), columns)})
    rows = spark.createDataFrame([('{"id":1,"a b":"é","x":1.5,"n":12345678901234567890,"raw":[0,255]}', 7), ('{"id":2,"raw":null}', 8), (None, 9)], "row string, kept int")
    typed = K.typed_rows(rows, contract.tables["t"])
    got = {r.kept: tuple(r)[1:] for r in typed.collect()}
    assert got == {7: (1, "é", 1.5, "12345678901234567890", bytearray(b"\x00\xff")), 8: (2, None, None, None, None), 9: (None,) * 5}
    empty = K.empty_tables(spark, contract)["t"]
    assert empty.count() == 0 and empty.schema == typed.drop("kept").schema
    with pytest.raises(Exception, match="no value of integer affinity"):
        K.typed_rows(spark.createDataFrame([('{"id":true}',)], "row string"), contract.tables["t"]).collect()
