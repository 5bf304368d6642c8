"""Deeply nested records as flat tables, linked by interval labels.

Every node of a record (run, configuration, fold, stop) gets the numbers at which a depth-first
walk enters and leaves it: ``pre`` and ``post``, both drawn from one counter that starts at 1 in
every record. A node lies below another one of the same record exactly if its interval lies
inside, so parents, ancestors and leaves need no path columns and no recursion.

The labels come from subtree sizes: the enter number of the k-th child is that of its parent
plus 1 plus twice the nodes in the earlier children. All of it is one narrow projection and one
``inline``; nothing is shuffled, whatever the number of rows per notebook.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from the top.
KINDS = ("run", "config", "fold", "stop")


#: Children of a node whose sizes are summed at once.
SPAN = 64


def _starts(items: Column, size: Callable[[Column], Column]) -> Column:
    """Twice the number of nodes in the items before each item, with a last element for them all.

    A list that grows by one element for each item costs the square of their number, so beyond ``SPAN`` items the
    sums of spans come first, and each item adds those of its own span.
    """
    zero = F.array(F.lit(0).cast("bigint"))
    grown = lambda sizes: F.aggregate(sizes, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    total = lambda sizes, first, n: F.aggregate(F.slice(sizes, first, n), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def spans(sizes: Column) -> Column:
        heads = grown(F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / SPAN).cast("int")), lambda c: total(sizes, c * SPAN + 1, F.lit(SPAN))))
        # Bound once, or every item would sum the spans anew.
        each = F.transform(F.array(heads), lambda h: F.concat(F.transform(sizes, lambda s, i: F.get(h, (i / SPAN).cast("int")) + total(sizes, (i / SPAN).cast("int") * SPAN + 1, i % SPAN)), F.array(F.element_at(h, -1))))
        return F.element_at(each, 1)

    sizes = F.transform(items, lambda x: 2 * size(x))
    return F.element_at(F.transform(F.array(sizes), lambda s: F.when(F.size(s) <= SPAN, grown(s)).otherwise(spans(s))), 1)


def _stops(fold: Column) -> Column:
    """The records among the stops of a fold, each with its place in the stored array."""
    placed = F.transform(F.coalesce(fold["stops"], F.array()), lambda s, i: F.struct(i.alias("at"), s.alias("v")))
    return F.filter(placed, lambda s: s["v"].isNotNull())


def _folds(config: Column) -> Column:
    placed = F.transform(F.coalesce(config["folds"], F.array()), lambda f, i: F.struct(i.alias("at"), f.alias("v"), _stops(f).alias("stops")))
    return F.filter(placed, lambda f: f["v"].isNotNull())


def _node(kind: str, pre: Column, size: Column, parent: Column, config: Column, fold_pos: Column, stop_pos: Column, values: Column | None, inner: Column | None, last: Column | None, with_values: bool) -> Column:
    null = F.lit(None)
    of = lambda source, name, type_: (null if source is None else source[name]).cast(type_).alias(name)
    place = [
        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("level"), pre.cast("bigint").alias("pre"), (pre + 2 * size - 1).cast("bigint").alias("post"),
        parent.cast("bigint").alias("parent_pre"), config.alias("config"), fold_pos.cast("int").alias("fold_pos"), stop_pos.cast("int").alias("stop_pos"),
    ]
    if not with_values:
        return F.struct(*place)
    return F.struct(
        *place, of(values, "rmse", "double"), of(values, "mae", "double"), of(values if kind == "config" else inner, "mape", "double"), of(values, "params", "bigint"),
        of(values, "futility_stop", "string"), of(inner, "fold", "int"), of(last, "epoch", "int"), of(last, "reason", "string"),
    )


def nodes(runs: DataFrame, keep: tuple[str, ...] = ("run_id", "notebook", "seed"), values: bool = True) -> DataFrame:
    """One row for each node of every record in ``results``, with its interval labels.

    Columns: those of ``keep``, then ``kind, level, pre, post, parent_pre, config, fold_pos,
    stop_pos`` and, with ``values``, those of the node's own level (null on other levels). Positions are places
    in the stored array from 0, null elements counted; levels that a node lacks are ``''`` and -1.

    A null element is no node; a configuration with a null value is one, with null values. Null
    and empty maps and arrays give a node without children. A null run row still gives its run
    node, so no parent is lost. Rows stored twice give their nodes twice. An empty table gives an
    empty table; further columns, also such as ``kind`` or ``pre``, are ignored unless in ``keep``.
    """
    none, nowhere = F.lit(""), F.lit(-1)
    configs = F.transform(
        F.map_entries(F.coalesce(F.col("results"), F.expr("map()").cast(runs.schema["results"].dataType))),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v"), _folds(e["value"]).alias("folds")),
    )
    configs = F.transform(configs, lambda c: F.struct(c["name"], c["v"], c["folds"], _starts(c["folds"], lambda f: 1 + F.size(f["stops"]).cast("bigint")).alias("starts")))
    size_of = lambda c: 1 + (F.element_at(c["starts"], -1) / 2).cast("bigint")
    labelled = runs.select(*[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)], configs.alias("_configs"))
    labelled = labelled.withColumn("_starts", _starts(F.col("_configs"), size_of))

    def stop_nodes(name: Column, value: Column, fold: Column, pre: Column) -> Column:
        return F.transform(fold["stops"], lambda s, k: _node("stop", pre + 1 + 2 * k, F.lit(1), pre, name, fold["at"], s["at"], None, None, s["v"], values))

    def fold_nodes(config: Column, pre: Column) -> Column:
        def one(fold: Column, k: Column) -> Column:
            at = pre + 1 + F.element_at(config["starts"], k + 1)
            own = _node("fold", at, 1 + F.size(fold["stops"]), pre, config["name"], fold["at"], nowhere, None, fold["v"], None, values)
            return F.concat(F.array(own), stop_nodes(config["name"], config["v"], fold, at))

        return F.flatten(F.transform(config["folds"], one))

    def config_nodes(config: Column, k: Column) -> Column:
        at = 2 + F.element_at(F.col("_starts"), k + 1)
        own = _node("config", at, size_of(config), F.lit(1), config["name"], nowhere, nowhere, config["v"], None, None, values)
        return F.concat(F.array(own), fold_nodes(config, at))

    root = _node("run", F.lit(1), 1 + (F.element_at("_starts", -1) / 2).cast("bigint"), F.lit(None), none, nowhere, nowhere, None, None, None, values)
    tree = F.concat(F.array(root), F.flatten(F.transform("_configs", config_nodes)))
    flat = labelled.select(*[F.col(f"_keep_{i}") for i in range(len(keep))], F.inline(tree))
    return flat.withColumnsRenamed({f"_keep_{i}": k for i, k in enumerate(keep)})


_COLUMNS = {
    "run": (),
    "config": ("config", "rmse", "mae", "mape", "params", "futility_stop"),
    "fold": ("config", "fold_pos", "fold", "mape"),
    "stop": ("config", "fold_pos", "stop_pos", "epoch", "reason"),
}


def node_table(labelled: DataFrame, kind: str) -> DataFrame:
    """The nodes of one kind with the columns of that kind; links stay ``parent_pre``, ``pre``, ``post``."""
    keep = [c for c in labelled.columns[: labelled.columns.index("kind")]]
    return labelled.filter(F.col("kind") == kind).select(*keep, "parent_pre", "pre", "post", *_COLUMNS[kind])


def leaves(labelled: DataFrame) -> DataFrame:
    """Nodes that contain no other node: those left right after they were entered."""
    return labelled.filter(F.col("post") == F.col("pre") + 1)


def contained(inner: DataFrame, outer: DataFrame, record: str = "run_id") -> DataFrame:
    """Pairs of nodes of one record where ``inner`` lies inside ``outer``.

    Columns ``<record>, inner_pre, outer_pre``. An equi-join on the record with the interval test
    as its further condition, so its cost is bounded by the nodes of single records.
    """
    a = inner.select(F.col(record), F.col("pre").alias("inner_pre"), F.col("post").alias("_inner_post"))
    b = outer.select(F.col(record), F.col("pre").alias("outer_pre"), F.col("post").alias("_outer_post"))
    inside = (F.col("outer_pre") < F.col("inner_pre")) & (F.col("_inner_post") < F.col("_outer_post"))
    return a.join(b, record).filter(inside).select(record, "inner_pre", "outer_pre")
