"""Merkle manifest of a dataset: a leaf a row, a tree a group, a tree over the groups' roots, and every row's proof.

Rows take their place in their group over range partitions (counts of the partitions before, no window over a group).
Blocks of FAN ** HEIGHT consecutive nodes are folded to one node each, a task a block, until few nodes are left: at most
TOP, whatever the number of rows. The driver builds the tree above them and broadcasts each one's path to the root: at
most TOP paths of some twenty entries. Executors then finish the proofs from the top down: a block's path and the
levels within it make the paths of its members. Where there are more groups than TOP, the groups' roots are the leaves
of one more tree of the same kind, and what is broadcast otherwise is a table.

Digests are lowercase hex SHA-256 of the concatenated hex of what they stand for.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.url_filters import LOWER, UPPER
from tramline.session import fresh, written

FAN = 8
#: Levels that one block folds: FAN ** HEIGHT nodes a block.
HEIGHT = 3
#: Nodes that the driver takes at most.
TOP = 4096
PATH = "array<struct<before string, after string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf(*columns: Column) -> Column:
    """Digest of a row's values: each `-` if null, else its length in UTF-8 bytes, `:` and the value as text, so no two rows share an encoding."""
    as_text = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]
    return F.sha2(F.concat(*parts), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _levels(nodes: list[str], n: int, fan: int, height: int | None = None) -> list[list[str]]:
    """Levels from `nodes` up: `height` of them, or as many as a tree of n nodes in all has."""
    out = [nodes]
    while n > 1 and (height is None or len(out) <= height):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)])
        n = -(-n // fan)
    return out


def _path(levels: list[list[str]], i: int, fan: int) -> list[dict[str, str]]:
    """What stands before and after the nodes on the way from node i of the lowest level to the highest level."""
    out = []
    for level in levels[:-1]:
        run = i - i % fan
        out.append({"before": "".join(level[run:i]), "after": "".join(level[i + 1 : run + fan])})
        i //= fan
    return out


def _top(rows: list, fan: int) -> dict[tuple[str, int], tuple[list[dict[str, str]], str, str]]:
    """(group, place) -> path to the root, subroot, root; for the few nodes that are left."""
    trees: dict[str, list[str]] = {}
    for g, _, digest in sorted((r[0], r[1], r[2]) for r in rows):
        trees.setdefault(g, []).append(digest)
    built = {g: _levels(nodes, len(nodes), fan) for g, nodes in trees.items()}
    over = _levels([built[g][-1][0] for g in trees], len(trees), fan)
    out = {}
    for at, g in enumerate(trees):
        above = _path(over, at, fan)
        for i in range(len(trees[g])):
            out[g, i] = (_path(built[g], i, fan) + above, built[g][-1][0], over[-1][0])
    return out


def _placed(rows: DataFrame, group: str, order: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Rows with their group as text that is never null and sorts as the group does (null first), their place in it from 0, and the group's size."""
    g, pos, n = names
    seq, part, first, base = fresh([*rows.columns, *names], "seq", "part", "first", "base")
    keyed = rows.withColumns({g: F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")), seq: F.monotonically_increasing_id()})
    # The row's number in what was read is the last key: equal rows, however many, fill more than one range.
    by = [g, *order, seq]
    held = written(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(seq, F.monotonically_increasing_id()).withColumn(part, F.shiftright(seq, 33)), "merkle-order")
    counts = held.groupBy(g, part).agg(F.count("*").alias(n), F.min(seq).alias(first))
    before = Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({base: F.coalesce(F.sum(n).over(before), F.lit(0)), n: F.sum(n).over(Window.partitionBy(g))})
    return held.join(counts, [g, part]).withColumn(pos, F.col(seq) - F.col(first) + F.col(base)).drop(seq, part, first, base)


def _reduced(digest: str, names: tuple[str, str, str], fan: int, height: int):
    g, pos, n = names

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        size = table[n][0].as_py()
        top = _levels(table[digest].to_pylist(), size, fan, height)[-1][0]
        return pa.table({g: [key[0].as_py()], pos: [key[1].as_py()], n: [-(-size // fan**height)], digest: [top]})

    return run


def _finished(digest: str, names: tuple[str, str, str], made: tuple[str, str, str], fan: int, height: int, shared):
    """Members of a block with their paths; what is above the block comes by broadcast, or as the one row of a table."""
    _, pos, n = names
    path, subroot, root = made

    def done(table: pa.Table, above: list[dict[str, str]], sub: str, top: str) -> pa.Table:
        table = table.sort_by(pos)
        levels = _levels(table[digest].to_pylist(), table[n][0].as_py(), fan, height)
        table = table.append_column(path, pa.array([_path(levels, i, fan) + above for i in range(len(table))], _PATH))
        return table.append_column(subroot, pa.array([sub] * len(table), pa.string())).append_column(root, pa.array([top] * len(table), pa.string()))

    def by_broadcast(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return done(table, *shared.value[key[0].as_py(), key[1].as_py()])

    def by_table(key: tuple[pa.Scalar, ...], table: pa.Table, over: pa.Table) -> pa.Table:
        return done(table, over[path][0].as_py(), over[subroot][0].as_py(), over[root][0].as_py())

    return by_table if shared is None else by_broadcast


def manifest(rows: DataFrame, group: str, order: list[str], digest: str = "leaf", fan: int = FAN, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """`rows` with `path` (what stands before and after on every level, to the root), `subroot` (of the row's group) and `root`.

    Within a group, rows ascend by `order`, then by digest; every `fan` consecutive nodes, the last run fewer, become their
    digest until one remains. Groups ascend by their text, bytewise, and their subroots make the root in the same way. A null
    group is a group (the first), null order values come first, equal rows each have a leaf, other columns stay (of older ones
    named path, subroot or root none does), an empty table gives an empty one.
    """
    spark = rows.sparkSession
    made = ("path", "subroot", "root")
    rows = rows.drop(*[c for c in rows.columns if c.lower() in made])
    names = tuple(fresh([*rows.columns, *made], "g", "pos", "n"))
    g, pos, n = names
    block = F.expr(f"`{pos}` div {fan**height}").alias("block")
    levels, up = [], written(_placed(rows, group, [*order, digest], names), "merkle-leaves")
    while True:
        levels.append(up)
        lower = up.select(g, pos, n, digest)
        up = written(lower.groupBy(g, block).applyInArrow(_reduced(digest, names, fan, height), lower.schema), "merkle-nodes")
        left, most = up.agg(F.count("*"), F.max(n)).first()
        if left <= top or most == 1:
            break
    shared, above = None, None
    if left <= top:
        shared = spark.sparkContext.broadcast(_top(up.select(g, pos, digest).collect(), fan))
    else:
        over = manifest(up.select(g, F.col(digest).alias("below"), F.lit(0).alias("all")), "all", [g], "below", fan, height, top)
        above = over.select(g, F.lit(0).cast("long").alias(pos), "path", F.col("below").alias("subroot"), "root")
    for nodes in reversed(levels):
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema] + [f"path {PATH}", "subroot string", "root string"])
        run = _finished(digest, names, made, fan, height, shared)
        blocks = nodes.groupBy(g, block)
        found = blocks.applyInArrow(run, schema) if shared is not None else blocks.cogroup(above.groupBy(g, pos)).applyInArrow(run, schema)
        shared, above = None, found.select(g, pos, *made)
    return found.drop(*names)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether its text still is what the manifest says where some were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = F.when(tampered, leaf(*columns(F.translate("text", UPPER, LOWER))))
    leaves = docs.select("doc_id", "lang", leaf(*columns(F.col("text"))).alias("leaf"), now.alias("now"))
    found = manifest(leaves, "lang", ["doc_id"])
    found = found.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(depth: int = 9, over: int = 4) -> str:
    """The tree level by level: FAN ** depth documents a language, FAN ** over languages at most."""
    enc = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 of ASCII text: the reflected polynomial 0xEDB88320, bit by bit.
    bit = "list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, {})"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint), lambda acc, x: " + bit.format("xor(acc, x)") + ", 4294967295::bigint), 4294967295)"
    out = [f"l as (select doc_id, lang, {row('text')} as leaf, case when {crc} % 3 = 0 then {row(f'translate(text, {UPPER!r}, {LOWER!r})')} end as now from documents)"]
    out.append("a0 as (select coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n, leaf as d, * from l)")
    climb = "select g, i // 8 as i, (n + 7) // 8 as n, case when n = 1 then min(d) else sha256(string_agg(d, '' order by i)) end as d from {0} group by g, i // 8, n"
    beside = "select x.g, x.i, coalesce(string_agg(y.d, '' order by y.i) filter (y.i < x.i), '') as b, coalesce(string_agg(y.d, '' order by y.i) filter (y.i > x.i), '') as e, x.n from {0} x join {0} y on x.g = y.g and x.i // 8 = y.i // 8 group by x.g, x.i, x.n"
    for k in range(depth):
        out += [f"s{k} as ({beside.format(f'a{k}')})", f"a{k + 1} as ({climb.format(f'a{k}')})"]
    out.append(f"z0 as (select '' as g, row_number() over (order by g) - 1 as i, count(*) over () as n, d, g as own from a{depth})")
    for k in range(over):
        out += [f"t{k} as ({beside.format(f'z{k}')})", f"z{k + 1} as ({climb.format(f'z{k}')})"]
    step = "case when {0}.n = 1 then f else sha256({0}.b || f || {0}.e) end as f, p || {0}.b || {0}.e as p"
    out.append("f0 as (select g, i, i as at, doc_id, leaf, coalesce(now, leaf) as f, '' as p from a0)")
    for k in range(depth):
        out.append(f"f{k + 1} as (select f.g, f.i // 8 as i, doc_id, leaf, {step.format(f's{k}')} from f{k} f join s{k} on f.g = s{k}.g and f.i = s{k}.i)")
    out.append(f"h0 as (select z0.i, doc_id, leaf, f, p, z0.d as subroot from f{depth} f join z0 on f.g = z0.own)")
    for k in range(over):
        out.append(f"h{k + 1} as (select h.i // 8 as i, doc_id, leaf, subroot, {step.format(f't{k}')} from h{k} h join t{k} on h.i = t{k}.i)")
    return "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, z{over}.d as root, sha256(p) as proof_sha256, f as folded_root, f = z{over}.d as verified from h{over} join z{over} on true"


OP11_SQL = _sql()
