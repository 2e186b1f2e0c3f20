"""Secret scans by one combined deterministic automaton.

All rules become one byte automaton by subset construction and minimisation. Each text is passed
once, one array access per byte; where an accepting state is reached, the rule's reversed
automaton finds the leftmost start after the rule's last match and its forward automaton the
longest end. A match is a head (which may be empty) and a tail of one class; tails that are too
short are dropped, but what they covered is not searched again.

Spans are in code points, the end exclusive, in order of start and then of the rules. Null and
empty texts have no spans. Rules are independent, so spans of different rules may overlap.
Repeated rows give equal rows. Long texts are passed whole; memory is that of the text and its
spans. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .automata import backwards, compile_trees, parse
from .common import map_batches, read_table, utf8


@dataclass(frozen=True)
class Rule:
    """head and tail expressions (the tail stands for one byte of it), least length of the tail,
    and how many bytes of tail the one-pass automaton waits for."""

    kind: str
    head: str
    tail: str
    least: int
    either_case: bool = False
    wait: int = 1


#: Formats of credentials.
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, wait=24),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN( (RSA|DSA|EC|OPENSSH|ENCRYPTED))? PRIVATE KEY----", "-", 1),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", 24),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 20),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        parts = [(parse(r.head, r.either_case), parse(r.tail, r.either_case)) for r in rules]
        waits = [("seq", (head, *[tail] * r.wait)) for r, (head, tail) in zip(rules, parts, strict=True)]
        whole = [("seq", (head, tail, ("many", tail))) for head, tail in parts]
        self.every = compile_trees(waits, anywhere=True)
        self.forward = [compile_trees([x], anywhere=False) for x in whole]
        self.heads = [compile_trees([("seq", (h, t))], anywhere=False) for h, t in parts]
        self.backward = [compile_trees([backwards(x)], anywhere=False) for x in whole]

    def spans(self, body: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes."""
        table, accepting, marks = self.every.table, self.every.accepting, self.every.marks
        found, last, state = [], [0] * len(self.rules), 0
        for i, byte in enumerate(body):
            state = table[state + byte]
            if state >= accepting:
                for k in marks[state]:
                    if i < last[k]:
                        continue
                    back = self.backward[k].longest(body[last[k] : i + 1][::-1], 0)
                    if back < 0:
                        continue
                    start = i + 1 - back
                    end = self.forward[k].longest(body, start)
                    last[k] = end
                    if end - self.tail_start(k, body, start, end) >= self.rules[k].least:
                        found.append((start, k, end))
        return sorted(found)

    def tail_start(self, k: int, body: bytes, start: int, end: int) -> int:
        """Where the match's tail begins: the first place at which the head and one byte of
        tail match together."""
        state, table, accepting, dead = 0, self.heads[k].table, self.heads[k].accepting, self.heads[k].dead
        for i in range(start, end):
            state = table[state + body[i]]
            if state >= accepting:
                return i
            if state == dead:
                break
        return end


def code_points(body: bytes, offsets: list[int]) -> np.ndarray:
    """Byte offsets as offsets in code points."""
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)))
    return starts[offsets]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", name: str = "spans"
) -> DataFrame:
    """docs with one more column (replacing one of its name): the spans found."""
    kept = [c for c in docs.columns if c != name]

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        scanner = Scanner(rules)

        def one(body: bytes) -> list[dict]:
            found = scanner.spans(body)
            if not found:
                return []
            points = code_points(body, [x for start, _, end in found for x in (start, end)]).tolist()
            return [
                {"kind": rules[k].kind, "start": s, "end": e}
                for (_, k, _), s, e in zip(found, points[::2], points[1::2], strict=True)
            ]

        def apply(batch):
            yield {c: batch.column(c) for c in kept} | {name: [one(x) for x in utf8(batch, text)]}

        return apply

    schema = docs.select(*kept).schema.add(StructType.fromDDL(f"{name} {SPANS}")[name])
    return map_batches(docs.select(*kept), make, schema)


def span_list(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each span replaced by the mark; overlapping spans count as one."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, x):
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(x["start"] < state["at"], state["parts"])
            .otherwise(
                F.concat(
                    state["parts"],
                    F.array(F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int")), F.lit(mark)),
                )
            )
            .alias("parts"),
        )

    def finish(state):
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(span_list(of(*(r.kind for r in BASE_RULES))).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
