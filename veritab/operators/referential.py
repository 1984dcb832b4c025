"""Foreign keys, orphans, hierarchies, and the graph of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Check, count_if, graded, literal_rows, rows
from ..plans.lineage import cut


@dataclass(frozen=True)
class Relation:
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"


def orphans(child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str], include_null: bool = False) -> DataFrame:
    """Child rows whose key no parent has. Keys with a null part are left out, or all of them included."""
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct()
    on = [child[c] == keys[f"__p{i}"] for i, c in enumerate(child_columns)]
    out = child.join(keys, on, "left_anti")
    return out if include_null else out.dropna(subset=list(child_columns))


def _counts(child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """``orphan`` rows, rows with a ``nulls`` part and ``total`` rows, by one join with the distinct parent keys."""
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct().withColumn("__hit", F.lit(True))
    own = child.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(child_columns)])
    null = F.greatest(F.lit(0), *[F.col(f"__c{i}").isNull().cast("int") for i in range(len(child_columns))]) == 1
    joined = own.join(keys, [F.col(f"__c{i}") == F.col(f"__p{i}") for i in range(len(child_columns))], "left")
    return joined.agg(count_if(F.col("__hit").isNull() & ~null).alias("orphan"), count_if(null).alias("nulls"), rows().alias("total"))


def _fk(name: str, issue: str, child_columns: Sequence[str], counts: DataFrame, with_null: bool) -> DataFrame:
    bad = F.col("orphan") + F.col("nulls") if with_null else F.col("orphan")
    return graded(counts, name, ",".join(child_columns), issue, bad, F.col("total"), grade="high")


def foreign_key(child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str], allow_null: bool = True, name: str = "foreign_key") -> Check:
    return Check(name, lambda df: _fk(name, "foreign_key_violation", child_columns, _counts(df, child_columns, parent, parent_columns), not allow_null))


def composite_foreign_key(child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str], check_partial_matches: bool = False) -> Check:
    """Several key columns; ``check_partial_matches`` adds the orphans whose first column alone is known."""

    def plan(df: DataFrame) -> DataFrame:
        out = _fk("composite_foreign_key", "composite_foreign_key_violation", child_columns, _counts(df, child_columns, parent, parent_columns), False)
        if not check_partial_matches:
            return out
        lost = orphans(df, child_columns, parent, parent_columns)
        part = lost.join(parent.select(F.col(parent_columns[0]).alias("__p")).distinct(), lost[child_columns[0]] == F.col("__p"), "left_semi").agg(rows().alias("bad")).crossJoin(df.agg(rows().alias("total")))
        return out.unionByName(graded(part, "composite_foreign_key", ",".join(child_columns), "partial_match", F.col("bad"), F.col("total"), grade="medium"))

    return Check("composite_foreign_key", plan)


def self_referential_fk(fk_column: str, pk_column: str, allow_null: bool = True) -> Check:
    return Check("self_referential_fk", lambda df: _fk("self_referential_fk", "self_reference_violation", [fk_column], _counts(df, [fk_column], df, [pk_column]), not allow_null))


def orphan_record(child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str], include_null_fk: bool = False) -> Check:
    return Check("orphan_record", lambda df: _fk("orphan_record", "orphan_record", child_columns, _counts(df, child_columns, parent, parent_columns), include_null_fk))


def multi_table_orphan(tables: Mapping[str, DataFrame], relations: Sequence[Relation], include_null_fk: bool = False) -> DataFrame:
    """A result row for each relation."""
    out = None
    for r in relations:
        one = _fk("multi_table_orphan", "orphan_record", [f"{r.child}.{c}" for c in r.child_columns], _counts(tables[r.child], r.child_columns, tables[r.parent], r.parent_columns), include_null_fk)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no relations")
    return out


def dangling_reference(child: DataFrame, child_columns: Sequence[str], parent_columns: Sequence[str], max_dangling_ratio: float = 1.0) -> Check:
    """Parents that no child refers to, if over ``max_dangling_ratio`` of all."""

    def plan(df: DataFrame) -> DataFrame:
        used = child.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(child_columns)]).distinct().withColumn("__hit", F.lit(True))
        one = df.join(used, [df[p] == used[f"__c{i}"] for i, p in enumerate(parent_columns)], "left").agg(count_if(F.col("__hit").isNull()).alias("bad"), rows().alias("total"))
        return graded(one, "dangling_reference", ",".join(parent_columns), "dangling_reference", F.col("bad"), F.col("total"), limit=max_dangling_ratio, grade="low")

    return Check("dangling_reference", plan)


def cascade_integrity(tables: Mapping[str, DataFrame], relations: Sequence[Relation]) -> DataFrame:
    """By each relation's action: keys without a parent, or, for SET_NULL, null keys. A child table under different actions is a conflict."""
    out = None
    for r in relations:
        counts = _counts(tables[r.child], r.child_columns, tables[r.parent], r.parent_columns)
        bad = F.col("nulls") if r.on_delete == "SET_NULL" else F.col("orphan")
        one = graded(counts, "cascade_integrity", f"{r.child}.{','.join(r.child_columns)}", f"cascade_{r.on_delete.lower()}", bad, F.col("total"), grade="medium" if r.on_delete == "SET_NULL" else "high")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no relations")
    actions: dict[str, set[str]] = {}
    for r in relations:
        actions.setdefault(r.child, set()).add(r.on_delete)
    mixed = [(t, "conflicting_actions") for t, found in sorted(actions.items()) if len(found) > 1]
    return out.unionByName(literal_rows(next(iter(tables.values())), "cascade_integrity", mixed, "medium")) if mixed else out


def _edges(relations: Sequence[Relation]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in relations:
        out.setdefault(r.child, []).append(r.parent)
        out.setdefault(r.parent, [])
    return out


def strong_components(edges: Mapping[str, Sequence[str]]) -> list[list[str]]:
    """Sets of names that reach each other: by forward and backward reachability, since graphs of tables are small."""
    def reach(start: str, step: Mapping[str, Sequence[str]]) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            for n in step.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    back: dict[str, list[str]] = {}
    for a, bs in edges.items():
        for b in bs:
            back.setdefault(b, []).append(a)
    left, out = dict.fromkeys([*edges, *back]), []
    while left:
        start = next(iter(left))
        own = reach(start, edges) & reach(start, back)
        out.append(sorted(own))
        for n in own:
            left.pop(n, None)
    return out


def topological_order(edges: Mapping[str, Sequence[str]]) -> list[str]:
    """Parents before children; raises on a cycle."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter(edges).static_order())


def circular_reference(relations: Sequence[Relation], allow_self_reference: bool = True) -> Check:
    edges = _edges(relations)
    found = [(",".join(c), "circular_reference") for c in strong_components(edges) if len(c) > 1 or not allow_self_reference and c[0] in edges[c[0]]]
    return Check("circular_reference", lambda df: literal_rows(df, "circular_reference", found, "high"))


def cascade_depth(relations: Sequence[Relation], max_depth: int = 5) -> Check:
    """The longest way from child to parent among the tables."""
    edges = {a: [b for b in bs if b != a] for a, bs in _edges(relations).items()}
    depth: dict[str, int] = {}
    try:
        for name in topological_order(edges):
            depth[name] = max((depth[b] + 1 for b in edges.get(name, ())), default=0)
        found = [(n, "cascade_too_deep") for n, d in depth.items() if d > max_depth]
    except ValueError:
        found = [("*", "circular_reference")]
    return Check("cascade_depth", lambda df: literal_rows(df, "cascade_depth", found, "medium"))


def ancestors(df: DataFrame, id_column: str, parent_column: str, max_depth: int) -> DataFrame:
    """``id, depth`` of each node: its number of ancestors, -1 if they run in a circle or are more than ``max_depth``. By pointer doubling: each round doubles the distance
    that is known, so rounds follow the logarithm of ``max_depth``; each is checkpointed, since the next one reads it twice. A parent that isn't a node ends the way, as a null one does."""
    nodes = df.select(F.col(id_column).cast("string").alias("id"), F.col(parent_column).cast("string").alias("up")).where("id is not null").dropDuplicates(["id"])
    known = nodes.select(F.col("id").alias("k"))
    walk = nodes.join(known, nodes["up"] == known["k"], "left").select("id", F.col("k").alias("up"), F.when(F.col("k").isNotNull(), 1).otherwise(0).cast("long").alias("depth"))
    reach = 1
    while reach <= max_depth:
        far = walk.select(F.col("id").alias("k"), F.col("up").alias("next"), F.col("depth").alias("more"))
        walk = cut(walk.join(far, walk["up"] == far["k"], "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        reach *= 2
    return walk.select("id", F.when(F.col("up").isNotNull() | (F.col("depth") > max_depth), -1).otherwise(F.col("depth")).alias("depth"))


def _walked(df: DataFrame, id_column: str, parent_column: str, name: str, issue: str, bad: Column, max_depth: int) -> DataFrame:
    one = ancestors(df, id_column, parent_column, max_depth).agg(count_if(bad).alias("bad"), rows().alias("total"), F.max("depth").alias("deepest"))
    return graded(one, name, parent_column, issue, F.col("bad"), F.col("total"), F.col("deepest"), grade="high")


def hierarchy_circular(id_column: str, parent_column: str, max_depth: int = 64, name: str = "hierarchy_circular") -> Check:
    """Nodes whose ancestors run in a circle."""
    return Check(name, lambda df: _walked(df, id_column, parent_column, name, "circular_hierarchy", F.col("depth") < 0, max_depth))


def hierarchy_depth(id_column: str, parent_column: str, max_depth: int = 10) -> Check:
    """Nodes with more than ``max_depth`` ancestors, or with a circle of them."""
    return Check("hierarchy_depth", lambda df: _walked(df, id_column, parent_column, "hierarchy_depth", "hierarchy_too_deep", (F.col("depth") < 0) | (F.col("depth") > max_depth), max(64, max_depth)))
