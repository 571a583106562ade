import pytest

from loomlog.errors import MalformedResponseError, SchemaMismatchError
from loomlog.operators import contract as K
from loomlog.operators import snapshot as S
from loomlog.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_round_trip_and_refusal(spark, tmp_path):
    decisions = T.decisions(spark, SF).select("stream_id", "operation_id", "client_id", "client_sequence", "intent_hash", "status", "sequence")
    log = decisions.where("status = 'accepted'")
    S.save(log, decisions, str(tmp_path / "good"))
    again, _ = S.load(spark, str(tmp_path / "good"))
    assert sorted(again.select(log.columns).collect()) == sorted(log.collect())
    assert len(list((tmp_path / "good" / "log").glob("stream_id=*"))) == 10
    S.save(log.where("sequence <> 3"), decisions, str(tmp_path / "bad"))
    with pytest.raises(MalformedResponseError):
        S.load(spark, str(tmp_path / "bad"))


def test_binding(spark):
    contract = K.Contract({"t": K.TableContract(("id",), {"id": K.ColumnContract("text", False)})})
    S.check_bound(spark.createDataFrame([("s", contract.schema_hash)], "stream_id string, schema_hash string"), contract)
    with pytest.raises(SchemaMismatchError):
        S.check_bound(spark.createDataFrame([("s", "sha256:0")], "stream_id string, schema_hash string"), contract)
