"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole. Tokens have character spans; sections have character
spans; the two sorted lists are joined by interval. A token inside one section counts for it. A token
that crosses a boundary is allocated by ``rule``:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, ties to the earlier;
* ``split``: to each section by its share of the token's characters.

Under every rule the counts of sections that cover a document sum to its number of tokens. Sections are
the lines of a text (a line ends after its newline), or any sorted spans that a caller gives. Tokens that touch
no section (spans may leave gaps) count for none; characters in gaps have no share. Byte-level
tokens can end within a character: a token's first character is that of its first byte, its last
that of its last byte.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.staging import small_batches

RULES = ("start", "majority", "split")
#: Fixed: the usual pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Fixed folder of vocabulary files by default; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_encoders: dict[str, tuple] = {}


def encoder(vocabulary: str):
    """(encoding, bytes of each token), made once in a process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encoders[vocabulary] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _encoders[vocabulary]


def token_spans(text: str, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of every token."""
    encoding, sizes = encoder(vocabulary)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    if (ends[-1] if len(ends) else 0) != len(raw):
        raise ValueError("the tokens do not spell the text")
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    return char[starts], char[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """(start, end) of the lines of a text, newline included; an empty text has one empty section."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array([[a, b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64)


def touched(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last section that each token touches; first > last where it touches none."""
    return np.searchsorted(sections[:, 1], starts, "right"), np.searchsorted(sections[:, 0], ends, "left") - 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. Sections are sorted and do not overlap; between them there may be gaps."""
    n = len(sections)
    if n and (np.any(sections[:, 0] > sections[:, 1]) or np.any(sections[1:, 0] < sections[:-1, 1])):
        raise ValueError("sections must be sorted and must not overlap")
    if not len(starts) or not n:
        return np.zeros(n)
    first, last = touched(starts, ends, sections)
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for i in np.flatnonzero(first < last):
        some = np.arange(first[i], last[i] + 1)
        share = np.minimum(ends[i], sections[some, 1]) - np.maximum(starts[i], sections[some, 0])
        if rule == "split":
            out[some] += share / share.sum()
        else:
            out[some[0] if rule == "start" else some[np.argmax(share)]] += 1
    return out


def count_tokens(docs: DataFrame, rule: str = "start", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", sections: str | None = None) -> DataFrame:
    """One row per section of each row: id, section (from 0), start, end, n_tokens, n_crossing and doc_tokens.

    ``n_tokens`` is what ``rule`` allocates, ``n_crossing`` the tokens that begin in the section and
    end beyond it. ``sections``: a column of (start, end) arrays, in characters, sorted and without overlaps (the job
    fails on others), by default the text's lines; a null array means lines, an empty one no section, hence no row.
    Null text counts as empty: one empty section with no tokens. Bytes that are no valid UTF-8 count as U+FFFD, as
    Python replaces them. Repeated rows are counted each; null ids stay null; other columns are not read. An
    empty table gives an empty result. The vocabulary file must be on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    given = F.col(sections).cast("array<struct<start:long,end:long>>") if sections else F.lit(None).cast("array<struct<start:long,end:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for doc_id, raw, spans in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                parts = line_sections(text) if spans is None else np.array([[s["start"], s["end"]] for s in spans], np.int64).reshape(-1, 2)
                starts, ends = token_spans(text, vocabulary)
                counts = attribute(starts, ends, parts, rule)
                cross = np.zeros(len(parts), np.int64)
                if len(parts) and len(starts):
                    at = np.minimum(touched(starts, ends, parts)[0], len(parts) - 1)
                    np.add.at(cross, at[(starts >= parts[at, 0]) & (starts < parts[at, 1]) & (ends > parts[at, 1])], 1)
                for c, v in zip(cols, ([doc_id] * len(parts), range(len(parts)), parts[:, 0].tolist(), parts[:, 1].tolist(), counts.tolist(), cross.tolist(), [len(starts)] * len(parts)), strict=True):
                    c.extend(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), given.alias("sections"))
    return rows.mapInArrow(run, "id long, section long, start long, end long, n_tokens double, n_crossing long, doc_tokens long").withColumnRenamed("id", id_col)
