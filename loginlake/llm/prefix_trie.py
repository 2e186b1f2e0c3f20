"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation's turns are cut into blocks of BLOCK turns. A block is one row: the key of the node it
begins at, and a column for each of its turns with that turn's id. One GROUP BY of block and key with ROLLUP
over the turn columns then counts all prefixes of all blocks together; grouping_id() tells how many
turns of its block a row has. Long conversations just have more rows, so their length sets no number of
jobs and no number of columns.

* A turn id is 128 bits of SHA-256 over place, role and text, in four numbers of 32 bits, with the code
  points of the text. The key of a node is the sum of the ids of its turns, number by number. Sums need no
  order, so a block's key comes from running sums over bounded chunks of blocks, and a parent's key is its
  child's less the last turn.
* Places come from a sort by ranges of (conversation, turn, role, text, row): a row's place is its distance
  from the first of its conversation in its range, and the rows of it in earlier ranges. A conversation
  with a third of all turns lies in many ranges.
* A node belongs to its smallest member, and a member owns the nodes of its path from some depth to its
  end. So sums over a subtree are sums over its members (second ROLLUP) of what each owns, less what the
  smallest member owns above the node; nothing walks up or down the trie.
* Ids of conversations that end at a node are joined to pieces of at most 2**PIECE_BITS ids, and the hash reads
  the pieces of a node in a row, a batch at a time.

Hot groups (one first turn, one conversation that a third of all equal) meet partial aggregates before
each shuffle; a join's hot side is split by adaptive execution, its other side has one row for a key.

Null roles and texts are empty. Turns of equal number are in order of role and text. Rows without
conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Texts of any length count
by digest and length only. Other columns are not read, so their names cannot clash. Without conversations
there are no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, read_table

BLOCK = 8
#: Blocks of one conversation in a chunk.
CHUNK = 1 << 16
PIECE_BITS = 12
#: Turns are borrowed from the first conversation of every so many ids, fewer than so many turns.
FAMILY, MOST_HEAD = 100, 6
KEY = ("k0", "k1", "k2", "k3")


def ordered(conversations: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Stored turns (conv_id, part, place, digest, chars), sorted over all parts, and stored
    runs (conv_id, part, first, n): the turns of a conversation in a part have places first to first + n - 1."""
    keys = ["conv_id", "turn", "role", "text", "row"]
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    sorted_turns = store.save(
        turns.repartitionByRange(*keys).sortWithinPartitions(*keys).selectExpr(
            "conv_id",
            "spark_partition_id() AS part",
            "monotonically_increasing_id() AS place",
            "sha2(concat(length(role), ':', role, text), 256) AS digest",
            "length(text) AS chars",
        ),
        "turns",
    )
    runs = sorted_turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return sorted_turns, store.save(runs, "runs")


def rebuilt(conversations: DataFrame, store: Store) -> DataFrame:
    """(conv_id, turns, p, digest, chars): turn p of turns of each rebuilt conversation, which begins with
    turns of the first of its family; p is null in the only row of one without turns."""
    spark = conversations.sparkSession
    sorted_turns, runs = ordered(conversations, store)
    convs = spark.sql(
        f"""
        WITH own AS (SELECT conv_id, sum(n) AS n, conv_id - conv_id % {FAMILY} AS base,
                            crc32(CAST(CAST(conv_id AS string) AS binary)) % {MOST_HEAD} AS head
                     FROM {{runs}} GROUP BY conv_id)
        SELECT own.conv_id, own.base, own.head, least(own.head, coalesce(first.n, 0)) AS taken,
               least(own.head, coalesce(first.n, 0)) + greatest(own.n - own.head, 0) AS turns
        FROM own LEFT JOIN own AS first ON own.base = first.conv_id
        """,
        runs=runs,
    )
    convs = store.save(convs, "conversations")
    placed = spark.sql(
        """
        WITH before AS (
          SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
          FROM {runs}
        ),
        starts AS (SELECT b.conv_id, part, 1 + earlier - first AS shift, head, taken, turns FROM before AS b JOIN {convs} AS c ON b.conv_id = c.conv_id)
        SELECT t.conv_id, place + shift AS p, head, taken, turns, digest, chars
        FROM {turns} AS t JOIN starts AS s ON t.conv_id = s.conv_id AND t.part = s.part
        """,
        runs=runs,
        convs=convs,
        turns=sorted_turns,
    )
    return spark.sql(
        f"""
        SELECT conv_id, turns, taken + p - head AS p, digest, chars FROM {{placed}} WHERE p > head
        UNION ALL
        SELECT c.conv_id, c.turns, p, digest, chars
        FROM {{convs}} AS c JOIN (SELECT conv_id, p, digest, chars FROM {{placed}} WHERE p < {MOST_HEAD}) AS h ON c.base = h.conv_id AND h.p <= c.taken
        UNION ALL
        SELECT conv_id, turns, NULL AS p, NULL AS digest, NULL AS chars FROM {{convs}} WHERE turns = 0
        """,
        placed=placed,
        convs=convs,
    )


def _total(parts: list[str]) -> str:
    return " + ".join(parts)


def blocks(turns: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turns, block, chars, k0..k3, before, t1..): rows of turn ids; key and code points before the block."""
    spark = turns.sparkSession
    digits = ", ".join(f"CAST(conv(substring(id, {8 * k + 1}, 8), 16, 10) AS bigint) AS k{k}" for k in range(4))
    sums = ["chars", *KEY]
    rows = spark.sql(
        f"""
        WITH ids AS (SELECT conv_id, turns, p, chars, sha2(concat(p, ':', digest), 256) AS id FROM {{turns}}),
        split AS (SELECT conv_id, turns, coalesce((p - 1) div {block}, 0) AS block, p, chars, {digits} FROM ids)
        SELECT conv_id, turns, block, block div {chunk} AS chunk, {", ".join(f"coalesce(sum({x}), 0) AS {x}" for x in sums)},
               sort_array(collect_list(if(p IS NULL, NULL, struct(p, {", ".join(KEY)}, chars)))) AS row
        FROM split GROUP BY conv_id, turns, block
        """,
        turns=turns,
    )
    near = "PARTITION BY conv_id, chunk ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    far = "PARTITION BY conv_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    columns = ", ".join(
        f"if(size(row) > {j}, struct({', '.join(f'get(row, {j}).{x} AS {x}' for x in (*KEY, 'chars'))}), NULL) AS t{j + 1}" for j in range(block)
    )
    return spark.sql(
        f"""
        WITH whole AS (SELECT conv_id, chunk, {", ".join(f"sum({x}) AS {x}" for x in sums)} FROM {{rows}} GROUP BY conv_id, chunk),
        long AS (SELECT * FROM (SELECT conv_id, chunk, {", ".join(f"sum({x}) OVER ({far}) AS {x}" for x in sums)} FROM whole) WHERE chunk > 0),
        running AS (SELECT *, {", ".join(f"coalesce(sum({x}) OVER ({near}), 0) AS in_{x}" for x in sums)} FROM {{rows}})
        SELECT r.conv_id, r.turns, r.block, r.chars, r.in_chars + coalesce(l.chars, 0) AS before,
               {", ".join(f"r.in_{x} + coalesce(l.{x}, 0) AS {x}" for x in KEY)}, {columns}
        FROM running AS r LEFT JOIN long AS l ON r.conv_id = l.conv_id AND r.chunk = l.chunk
        """,
        rows=rows,
    )


def _rolled(rows: DataFrame, values: str, block: int) -> DataFrame:
    """One row per node: depth, key k0..k3, the key's share of the last turn (l0..l3), code points of the last
    text and of all before it (chars, pre), and the values, which are aggregates over the members."""
    turns = [f"t{j + 1}" for j in range(block)]
    level = f"({block} - bit_count(grouped))"
    last = f"get(array({', '.join(turns)}), {level} - 1)"
    return rows.sparkSession.sql(
        f"""
        WITH rolled AS (
          SELECT block, before, {", ".join(KEY)}, {", ".join(turns)}, grouping_id() AS grouped, {values}
          FROM {{rows}} GROUP BY block, before, {", ".join(KEY)}, ROLLUP({", ".join(turns)})
        ),
        nodes AS (SELECT *, {level} AS level, {last} AS last FROM rolled)
        SELECT * EXCEPT (block, before, {", ".join(KEY)}, {", ".join(turns)}, grouped, level, last),
               block * {block} + level AS depth,
               {", ".join(f"{k} + {_total([f'coalesce({t}.{k}, 0)' for t in turns])} AS {k}" for k in KEY)},
               {", ".join(f"coalesce(last.{k}, 0) AS l{k[1:]}" for k in KEY)},
               coalesce(last.chars, 0) AS chars,
               before + {_total([f"coalesce({t}.chars, 0)" for t in turns])} - coalesce(last.chars, 0) AS pre
        FROM nodes WHERE if(level = 0, block = 0, last IS NOT NULL)
        """,
        rows=rows,
    )


def _hashed(pieces: DataFrame) -> DataFrame:
    """(k0..k3, depth, ends_sha256): SHA-256 of the pieces of each node in order, joined by commas."""
    node = [*KEY, "depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = digest = None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in [*node, "ids"]), strict=True):
                if key != current:
                    if current is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _table(done)
        if current is not None:
            yield _table([(*current, digest.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*node, "ends_sha256"])

    in_order = pieces.repartition(*node).sortWithinPartitions(*node, "piece")
    return in_order.select(*node, "ids").mapInArrow(run, ", ".join(f"{c} bigint" for c in node) + ", ends_sha256 string")


def trie(
    turns: DataFrame, store: Store, block: int = BLOCK, chunk: int = CHUNK, piece_bits: int = PIECE_BITS
) -> DataFrame:
    """The nodes over conversations given as (conv_id, turns, p, digest, chars), see rebuilt(): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    rows = store.save(blocks(turns, block, chunk), "blocks")
    nodes = store.save(_rolled(rows, "min(conv_id) AS conv_id, max(turns) AS longest", block), "nodes")
    linked = spark.sql(
        f"""
        SELECT n.conv_id, n.depth, n.chars, n.pre, n.longest = n.depth AS childless, {", ".join(f"n.{k}" for k in KEY)}, p.conv_id AS parent_conv_id
        FROM {{nodes}} AS n LEFT JOIN (SELECT conv_id, depth, {", ".join(KEY)} FROM {{nodes}}) AS p
          ON n.depth - 1 = p.depth AND {" AND ".join(f"n.{k} - n.l{k[1:]} = p.{k}" for k in KEY)}
        """,
        nodes=nodes,
    )
    linked = store.save(linked, "linked")
    members = spark.sql(
        """
        SELECT conv_id, sum(total) AS total, sum(own) AS own, min(above) AS above, max(leaf) AS leaf
        FROM (SELECT conv_id, chars AS total, 0 AS own, NULL AS above, 0 AS leaf FROM {rows}
              UNION ALL SELECT conv_id, 0, chars, pre, CAST(childless AS int) FROM {linked})
        GROUP BY conv_id
        """,
        rows=rows,
        linked=linked,
    )
    with_own = rows.join(members, "conv_id")
    summed = _rolled(
        with_own,
        "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS total, sum(own) AS own, sum(leaf) AS n_leaves, min_by(above, conv_id) AS above",
        block,
    )
    turn_columns = [f"t{j + 1}" for j in range(block)]
    pieces = spark.sql(
        f"""
        SELECT {", ".join(KEY)}, depth, shiftright(conv_id, {piece_bits}) AS piece, array_join(sort_array(collect_list(conv_id)), ',') AS ids
        FROM (SELECT conv_id, turns AS depth, {", ".join(f"{k} + {_total([f'coalesce({t}.{k}, 0)' for t in turn_columns])} AS {k}" for k in KEY)}
              FROM {{rows}} WHERE block = greatest(turns - 1, 0) div {block})
        GROUP BY {", ".join(KEY)}, depth, piece
        """,
        rows=rows,
    )
    return spark.sql(
        f"""
        WITH children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM {{linked}} WHERE depth > 0 GROUP BY ALL),
        ended AS (SELECT l.conv_id, l.depth, parent_conv_id, ends_sha256 FROM {{linked}} AS l
                  LEFT JOIN {{ends}} AS e ON l.depth = e.depth AND {" AND ".join(f"l.{k} = e.{k}" for k in KEY)})
        SELECT s.conv_id, s.depth, parent_conv_id, s.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
               s.total - s.n_convs * s.pre - (s.own - (s.pre - s.above)) AS saved_tokens,
               coalesce(ends_sha256, sha2('', 256)) AS ends_sha256
        FROM {{summed}} AS s JOIN ended AS e ON s.conv_id = e.conv_id AND s.depth = e.depth
        LEFT JOIN children AS c ON s.conv_id = c.conv_id AND s.depth = c.depth
        """,
        linked=linked,
        ends=_hashed(pieces),
        summed=summed,
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    store = Store(spark, "trie")
    nodes = trie(rebuilt(read_table(spark, sf_dir, "conversations"), store), store)
    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.select(*(F.col(c).cast("bigint").alias(c) for c in longs), "ends_sha256")


OP11_SQL = f"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
               lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))),
             4294967295::BIGINT) % {MOST_HEAD} AS head
  FROM named GROUP BY conv_id
),
whole AS (
  SELECT c.conv_id, coalesce(list({{'role': t.role, 'text': t.text}} ORDER BY t.own, t.p) FILTER (WHERE t.p IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN (SELECT conv_id, role, text, p, false AS own FROM named UNION ALL SELECT conv_id, role, text, p, true FROM named) t
    ON (NOT t.own AND t.conv_id = c.base AND t.p <= c.head) OR (t.own AND t.conv_id = c.conv_id AND t.p > c.head)
  GROUP BY c.conv_id
),
nodes AS (
  SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(path[depth].text)) AS chars,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth) AS ends
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM whole) GROUP BY ALL
),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
)
SELECT v.conv_id::BIGINT AS conv_id, v.depth::BIGINT AS depth, any_value(v.parent_conv_id)::BIGINT AS parent_conv_id, any_value(v.n_convs)::BIGINT AS n_convs,
       any_value(v.n_children)::BIGINT AS n_children, count(*) FILTER (WHERE w.n_children = 0)::BIGINT AS n_leaves,
       sum((w.n_convs - 1) * coalesce(w.chars, 0))::BIGINT AS saved_tokens, sha256(coalesce(any_value(v.ends), '')) AS ends_sha256
FROM counted v JOIN counted w ON w.depth >= v.depth AND w.path[1:v.depth] = v.path
GROUP BY v.conv_id, v.depth
"""
