"""Merkle manifest of a dataset: a root for all rows, and for each row a proof that it is in it.

Each row is a leaf: the SHA-256 of its columns, each ``-`` if null, else its length in bytes,
a colon and the value. Within a group (``source``), leaves are in the order of their ids; in
every level runs of ``FAN`` nodes become their hash until one node, the subroot, is left.
Subroots, in the order of their groups, are the leaves of a tree over the groups, which gives
the root.

Window-based levels: nodes are partitioned by group and parent index, and a ``collect_list``
over the full frame, in order, gives every node its run: the hash of the run is the parent,
the run without the node is its siblings. The first node of each run stands for the parent in
the next level. No window holds more than ``FAN`` rows, however large a group. Places come
from a range sort with partition offsets, so a hot group is cut over many tasks.

Proofs are handed down: every node joins its parent's path (at most ``FAN`` children a
parent, never a group's rows by the group) on the keys of its window, so nodes are shuffled
once a level. Only hashes and places are written; texts are read once.

Defined results: null groups are a group of their own, before all others; null ids come first
in a group; rows of equal id are ordered by leaf (equal rows by their number, which changes
nothing that is returned but which of them has which proof); an empty table gives an empty
result; a table of one row has its leaf as root and the hash of nothing as proof; columns
beside those hashed are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.llm.common import crc_mod, documents, quoted, staged
from emberlens.llm.exact_dedup import fold
from emberlens.llm.ranks import numbered
from emberlens.llm.resampling import CRC32_SQL, crc32_sql

FAN, HEX = 16, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<pos:int,siblings:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value so that a sequence of them can be read back: null is ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(framed, values)))


def with_runs(nodes: DataFrame) -> DataFrame:
    """Nodes of groups of more than one, with ``parent``, ``pos`` in the run, and the ``run``: its hashes in order."""
    frame = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = nodes.where("n > 1").withColumns({"parent": F.floor(F.col("idx") / FAN), "pos": (F.col("idx") % FAN).cast("int")})
    return spread.withColumn("run", F.concat_ws("", F.collect_list("hash").over(frame)))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (``g, idx, n, hash``; a written table) and the levels above them.

    ``n`` is the number of the group's nodes in the level. A group ends at the level where it
    is 1; there are as many levels as the largest group needs.
    """
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        firsts = with_runs(found[-1]).where("pos = 0")
        above = firsts.select("g", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), digest(F.col("run")).alias("hash"))
        found.append(staged(above, "level"))
        most = -(-most // FAN)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """``g, hash`` of the last node of each group."""
    ends = [x.where("n = 1").select("g", "hash") for x in found]
    out = ends[0]
    for x in ends[1:]:
        out = out.unionAll(x)
    return out


def handed_down(found: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest level with what ``ends`` (one row a group, with ``path``) gives to its group's top.

    ``path`` grows on the way down: from each node up, its place in the run and its siblings.
    """
    carried = [c for c in ends.columns if c not in ("g", "path")]
    known = None
    for height in range(len(found) - 1, -1, -1):
        level = found[height]
        here = level.where("n = 1").join(ends, "g").select(*level.columns, "path", *carried)
        if known is not None:
            up = known.select(F.col("g").alias("up_g"), F.col("idx").alias("up_idx"), F.col("path").alias("up_path"), *carried)
            rows = with_runs(level)
            at = F.col("pos") * HEX
            others = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + HEX + 1))
            step = F.array(F.struct("pos", others.alias("siblings")))
            joined = rows.join(up, (rows["g"] == up["up_g"]) & (rows["parent"] == up["up_idx"]))
            below = joined.select(*level.columns, F.concat(step, "up_path").cast(_PATH).alias("path"), *carried)
            here = below.unionAll(here)
        known = here if height == 0 else staged(here, "known")
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path of siblings give."""

    def up(current: Column, step: Column) -> Column:
        cut = step["pos"] * HEX
        return digest(F.concat(F.substr(step["siblings"], F.lit(1), cut), current, F.substr(step["siblings"], cut + 1)))

    return F.aggregate(path, start, up)


def proof(path: Column) -> Column:
    """One hash over all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: step["siblings"]), ""))


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id, leaf, path, subroot, root``, and ``extra`` (Columns over ``docs``)."""
    group = F.col(quoted(group_col)).cast("string")
    leaves = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(quoted(id_col)).alias("id"),
        F.when(group.isNull(), "-").otherwise(F.concat(F.lit(":"), group)).alias("g"),  # "-" is before ":"
        leaf([F.col(quoted(c)) for c in columns]).alias("hash"),
        *[c.alias(k) for k, c in (extra or {}).items()],
    )
    order = [F.asc("g"), F.asc_nulls_first("id"), F.asc("hash"), F.asc("rid")]
    within = levels(staged(numbered(staged(leaves, "leaves"), "g", order), "level"))

    subroots = staged(tops(within).select(F.lit("").alias("all"), F.col("g").alias("name"), "hash"), "subroots")
    across = numbered(subroots, "all", [F.asc("all"), F.asc("name")])
    over = levels(staged(across.select(F.col("all").alias("g"), "name", "idx", "n", "hash"), "level"))
    root = tops(over).select("g", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    ends = handed_down(over, root).select(F.col("name").alias("g"), "path", F.col("hash").alias("subroot"), "root")
    return handed_down(within, staged(ends, "ends")).select("id", F.col("hash").alias("leaf"), "path", "subroot", "root", *(extra or {}))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = leaf([fold(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    tampered = {"tampered": F.when(crc_mod("doc_id", 5) == 0, changed)}
    found = manifest(documents(spark, sf_dir), extra=tampered)
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _levels_sql(name: str, height: int) -> str:
    """Levels ``name``1 to ``name``height over ``name``0 (g, idx, n, h); a level of one node goes up as it is."""
    return ",\n".join(
        f"{name}{k + 1} AS (SELECT g, idx // 16 AS idx, (max(n) + 15) // 16 AS n, list(h ORDER BY idx) AS run,"
        f" CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY g, idx // 16)"
        for k in range(height)
    )


#: Levels that the SQL has: enough for 16 ** 6 rows a source and 16 ** 4 sources.
_LEVELS_SQL, _OVER_SQL = 6, 4


def _op12_sql() -> str:
    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [(f"w{k + 1}", f"(a.idx // {16**k})", f"a.g = w{k + 1}.g") for k in range(_LEVELS_SQL)]
    steps += [(f"o{k + 1}", f"(s.idx // {16**k})", "true") for k in range(_OVER_SQL)]
    joins, siblings, current, folds = [], [], "a.start", []
    for i, (t, idx, same) in enumerate(steps):
        joins.append(f"JOIN {t} ON {same} AND {t}.idx = {idx} // 16")
        siblings.append(f"array_to_string({t}.run[1:{idx} % 16] || {t}.run[{idx} % 16 + 2:], '')")
        one = f"len({t}.run) = 1 AND {t}.n = 1 AND {t}.h = {t}.run[1]"
        folds.append(f"c{i + 1} AS (SELECT *, CASE WHEN one[{i + 1}] THEN c{i} ELSE sha256(lefts[{i + 1}] || c{i} || rights[{i + 1}]) END AS c{i + 1} FROM c{i})")
        steps[i] = (f"array_to_string({t}.run[1:{idx} % 16], '')", f"array_to_string({t}.run[{idx} % 16 + 2:], '')", one)
    lefts, rights, ones = (", ".join(x) for x in zip(*steps))
    return f"""
WITH {CRC32_SQL.strip()},
leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS g, {leaf_sql("text")} AS h,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf_sql(low)} END AS tampered
  FROM documents, crc_table),
w0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n,
       coalesce(tampered, h) AS start FROM leaves),
{_levels_sql("w", _LEVELS_SQL)},
o0 AS (SELECT 0 AS g, g AS name, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n, h FROM w{_LEVELS_SQL}),
{_levels_sql("o", _OVER_SQL)},
c0 AS (
  SELECT a.doc_id, a.h AS leaf, s.h AS subroot, o{_OVER_SQL}.h AS root, a.start AS c0,
         sha256({" || ".join(siblings)}) AS proof_sha256, [{lefts}] AS lefts, [{rights}] AS rights, [{ones}] AS one
  FROM w0 a JOIN o0 s ON a.g = s.name {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, c{len(folds)} AS folded_root, c{len(folds)} = root AS verified FROM c{len(folds)}
"""


OP12_SQL = _op12_sql()
