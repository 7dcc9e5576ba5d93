"""Token counts by field and section: encode a whole document once, then give its tokens to the spans they lie in.

The fields are joined into one text, encoded as the model would see it. Each token has a span of characters, from the one of its first
byte to the one of its last; an interval join finds the sections that each span meets. A token that crosses a boundary goes by an
explicit rule:
  start  to the section of its first character (the default)
  end    to the section of its last character
  most   to the section with most of its characters, the first of equals
  split  to each section by its share of characters
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.bpe import encoder_of, read_ranks
from mediagraph.llm.decontam import spread

RULES = ("start", "end", "most", "split")


def token_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last. sizes: bytes of the tokens that make up data, in order.

    A token that begins or ends inside a character has that character in its span."""
    ends = np.cumsum(sizes)
    if data.isascii():
        return ends - sizes, ends
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return char[ends - sizes], char[ends - 1] + 1


def interval_join(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, section and shared characters for each token and each section it meets, in order.

    Section k reaches from bounds[k] to bounds[k + 1]; empty sections meet nothing."""
    first, last = np.searchsorted(bounds, starts, side="right") - 1, np.searchsorted(bounds, ends - 1, side="right") - 1
    token = np.repeat(np.arange(len(starts)), last - first + 1)
    section = spread(first, last - first + 1)
    shared = np.minimum(ends[token], bounds[section + 1]) - np.maximum(starts[token], bounds[section])
    held = shared > 0
    return token[held], section[held], shared[held]


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, by the rule."""
    n = len(bounds) - 1
    if not len(starts):
        return np.zeros(n)
    token, section, shared = interval_join(starts, ends, bounds)
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    if rule == "split":
        return np.bincount(section, shared / (ends - starts)[token], n)
    if rule == "end":
        at = np.append(begins[1:], len(token)) - 1
    elif rule == "most":
        best = np.repeat(np.maximum.reduceat(shared, begins), np.diff(np.append(begins, len(token))))
        top = np.flatnonzero(shared == best)
        at = top[np.append(True, token[top][1:] != token[top][:-1])]
    else:
        at = begins
    return np.bincount(section[at], minlength=n).astype(float)


def sections_of(fields: list[str | None], names: list[str], body: int) -> tuple[str, list[str], list[str]]:
    """The joined text, and name and text of each section: the fields with the line break after them, the body field in two sections,
    `title` (its first line) and `body` (the others). A null field is empty."""
    found, parts = [], []
    for i, (value, name) in enumerate(zip(fields, names, strict=True)):
        text = (value or "") + ("\n" if i < len(fields) - 1 else "")
        if i == body:
            cut = text.find("\n") + 1 or len(text)
            found += ["title", "body"]
            parts += [text[:cut], text[cut:]]
        else:
            found.append(name)
            parts.append(text)
    return "".join(parts), found, parts


def section_tokens(docs: DataFrame, rank_path: str, pattern: str, fields: tuple[str, ...] = ("source", "lang", "text"), body: str = "text", rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """doc_id, section, section_bytes, n_tokens (double) and doc_tokens: a row for each document and section.

    The n_tokens of a document's sections add up to its doc_tokens. A null field, or one that docs lacks, is empty; an empty section
    has no bytes and no tokens; rows are counted each, also where they repeat; other columns are not read; an empty table gives an
    empty table. Texts of any length are encoded whole, a document at a time.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    names, at = list(fields), fields.index(body)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        sizes = np.zeros(max(encoder.v.tokens, default=0) + 1, np.int64)
        for i, token in encoder.v.tokens.items():
            sizes[i] = len(token)
        for batch in batches:
            ids, kinds, lengths, counts, totals = [], [], [], [], []
            for row in zip(*batch.columns, strict=True):
                text, found, parts = sections_of([c.as_py() for c in row[1:]], names, at)
                tokens = np.frombuffer(encoder.packed(text), np.int32)
                starts, ends = token_spans(text.encode("utf-8", "surrogatepass"), sizes[tokens])
                bounds = np.append(0, np.cumsum([len(p) for p in parts]))
                ids += [row[0].as_py()] * len(found)
                kinds += found
                lengths += [len(p.encode("utf-8", "surrogatepass")) for p in parts]
                counts.append(allocate(starts, ends, bounds, rule))
                totals += [len(tokens)] * len(found)
            made = (pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(np.concatenate([*counts, np.zeros(0)])), pa.array(totals, pa.int64()))
            yield pa.RecordBatch.from_arrays(list(made), names=["doc_id", "section", "section_bytes", "n_tokens", "doc_tokens"])

    return given.mapInArrow(count, "doc_id long, section string, section_bytes long, n_tokens double, doc_tokens long")
