"""Declarations of the test tables."""

from __future__ import annotations

from keelson.specs import Check, Column, ForeignKey, TableSpec, Unique


def _columns(text: str) -> tuple[Column, ...]:
    """``name type`` pairs; a trailing ``!`` marks NOT NULL."""
    out = []
    for part in text.split(","):
        name, dtype = part.split()
        out.append(Column(name, dtype.rstrip("!"), nullable=not dtype.endswith("!")))
    return tuple(out)


SPECS = {
    s.name.split(".")[1]: s
    for s in [
        TableSpec("region", _columns("r_regionkey int!, r_name string!"), ("r_regionkey",), (Unique(("r_name",)),)),
        TableSpec(
            "nation",
            _columns("n_nationkey int!, n_name string!, n_regionkey int!"),
            ("n_nationkey",),
            (Unique(("n_name",)),),
            foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),),
        ),
        TableSpec(
            "customer",
            _columns("c_custkey bigint!, c_name string!, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("c_custkey",),
            checks=(Check("acctbal_not_negative", "c_acctbal >= 0"),),
            foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),),
        ),
        TableSpec(
            "supplier",
            _columns("s_suppkey bigint!, s_name string!, s_nationkey int, s_acctbal double"),
            ("s_suppkey",),
            foreign_keys=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),),
        ),
        TableSpec(
            "part",
            _columns(
                "p_partkey bigint!, p_name string!, p_brand string, p_type string, p_size int, p_retailprice double"
            ),
            ("p_partkey",),
            (Unique(("p_name", "p_brand")),),
        ),
        TableSpec(
            "orders",
            _columns(
                "o_orderkey bigint!, o_custkey bigint!, o_orderstatus string!, o_totalprice double,"
                "o_orderdate timestamp_ntz, o_orderpriority string"
            ),
            ("o_orderkey",),
            checks=(Check("known_status", "o_orderstatus IN ('O', 'F', 'P')"),),
            foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
        ),
        TableSpec(
            "lineitem",
            _columns(
                "l_orderkey bigint!, l_partkey bigint!, l_suppkey bigint!, l_linenumber int!, l_quantity double!,"
                "l_extendedprice double!, l_discount double, l_tax double, l_returnflag string,"
                "l_linestatus string, l_shipdate timestamp_ntz"
            ),
            ("l_orderkey", "l_linenumber"),
            checks=(Check("small_discount", "l_discount <= 0.05"), Check("positive_quantity", "l_quantity > 0")),
            foreign_keys=(
                ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),
                ForeignKey(("l_partkey",), "part", ("p_partkey",)),
                ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",)),
            ),
        ),
        TableSpec(
            "events",
            _columns(
                "event_id bigint!, ts timestamp_ntz!, user_id bigint!, event_type string!, value double, props string"
            ),
            ("event_id",),
            foreign_keys=(ForeignKey(("user_id",), "customer", ("c_custkey",)),),
        ),
        TableSpec(
            "documents",
            _columns("doc_id bigint!, text string!, lang string, source string, n_chars bigint"),
            ("doc_id",),
            (Unique(("text",)),),
        ),
        TableSpec(
            "labels",
            _columns("doc_id bigint!, quality int, toxic int"),
            ("doc_id",),
            foreign_keys=(ForeignKey(("doc_id",), "documents", ("doc_id",)),),
        ),
        TableSpec("pages", _columns("page_id bigint!, url string!, html string"), ("page_id",)),
        TableSpec("benchmark", _columns("item_id bigint!, text string!"), ("item_id",)),
        TableSpec("embeddings", _columns("vec_id bigint!, embedding array<float>, label int"), ("vec_id",)),
        TableSpec(
            "conversations",
            _columns("conv_id bigint!, turn bigint!, role string, text string"),
            ("conv_id", "turn"),
        ),
    ]
}
