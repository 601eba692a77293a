"""Line items without an order: the given tables hold none, so some orders are taken out here."""

import shutil

import pyarrow.compute as pc
import pyarrow.parquet as pq

import check_oracles
from conftest import SMALL
from lodestar import workload


def test_lines_without_an_order_are_found_whatever_the_status_of_the_others(spark, tmp_path):
    for name in check_oracles.TABLES:
        shutil.copyfile(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders, lines = pq.read_table(f"{SMALL}/orders.parquet"), pq.read_table(f"{SMALL}/lineitem.parquet")
    gone = pc.equal(pc.bit_wise_and(orders["o_orderkey"], 7), 3)
    kept, missing = orders.filter(pc.invert(gone)), set(orders.filter(gone)["o_orderkey"].to_pylist())
    assert set(kept["o_orderstatus"].to_pylist()) >= {"F", "O"}
    pq.write_table(kept, tmp_path / "orders.parquet")
    entry = workload.load()["k03_orphan_lines"]
    assert check_oracles.compare(entry.run(spark, str(tmp_path)), check_oracles.duck(str(tmp_path)), entry.sql) is None
    want = sorted((r["l_orderkey"], r["l_linenumber"]) for r in lines.to_pylist() if r["l_orderkey"] in missing)
    got = sorted((r.l_orderkey, r.l_linenumber) for r in entry.run(spark, str(tmp_path)).collect())
    assert want and got == want
