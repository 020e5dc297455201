"""Operator 2: quality rules as a ledger of failure bits.

One pass over the whole texts takes the measurements; every rule is then evaluated once as a bit of ``fail_bits``. Policies
are versioned sets of bits: a policy keeps a document if none of its bits is set, so a new version, or an ablation of any
rule, reads the ledger's bits and never a text again. Ablations count bit patterns first (at most 2 to the number of rules)
and work on those counts with bitwise operations.

Words are runs of anything but the six ASCII white space characters. Defined results: null text counts as empty; empty texts
and texts without words have zeros and fail ``few_words``; repeated rows give a row each; an empty table gives no rows;
columns other than id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SPACE, _UPPER, _LOWER = b" \t\n\v\f\r", bytes(range(65, 91)), bytes(range(97, 123))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "top_word", "n_upper", "n_lower")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that are found twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code, kinds = ids[:n], len(number)
    for k in range(1, window):
        if kinds > (1 << 62) // len(number):
            _, code = np.unique(code, return_inverse=True)
            kinds = n
        code = code * len(number) + ids[k : k + n]
        kinds *= len(number)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    top = 0
    if words:
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        top = int(np.bincount(np.fromiter(map(number.__getitem__, words), np.int64, len(words))).max())
    return (len(words), len(text) - count(_SPACE), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), top, count(_UPPER), count(_LOWER))


def _measured(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 1000):
            rows = list(zip(*(measure(t.as_py()) for t in texts[at : at + 1000])))
            yield pa.RecordBatch.from_arrays([ids[at : at + 1000], *(pa.array(c, pa.int64()) for c in rows)], names=["doc_id", *MEASURES])


#: Bit, name and when the rule fails. A bit never changes its meaning; new rules take new bits.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    (4, "short_words", "2 * word_chars < 5 * n_words"),
    (5, "long_words", "word_chars > 14 * n_words"),
    (6, "one_word", "n_words >= 20 and 100 * top_word > 30 * n_words"),
    (7, "capitals", "10 * n_upper > 3 * (n_upper + n_lower)"),
)
#: Versions of the policy: the names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(name for _, name, _ in RULES),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return reduce(lambda m, name: m | 1 << bits[name], POLICIES[policy] if isinstance(policy, str) else policy, 0)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements..., fail_bits long) for every row."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, _, test in RULES]
    return measured.withColumn("fail_bits", reduce(Column.bitwiseOR, bits))


def keeps(policy: str | tuple[str, ...], bits: str = "fail_bits") -> Column:
    """Whether the policy keeps a row of the ledger."""
    return F.col(bits).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, fails, alone, kept_without) of each rule of a policy: rows that fail it, that fail it alone, and that are kept without it."""
    mask = policy_mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if mask >> bit & 1])
    each = patterns.select("bits", "n", F.explode(named).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        total(F.col("bits") == F.col("bit")).alias("alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def apply_policy(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: not rejected by the base rules, nor by ``policy``."""
    return ledger(docs, id_col, text_col).withColumn("base_failed", ~keeps("base")).withColumn("kept", keeps("base") & keeps(policy))
