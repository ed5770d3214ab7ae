"""Token counts by section, with tokens attributed by their spans.

Each document is encoded once, whole.  Its sections are its lines (a line with
its closing newline), as half-open ranges of the text's UTF-8; token spans are
joined to them by interval.  A token inside one section counts there.  A token
that crosses a boundary is allocated by the rule: to the section that holds most
of its bytes, the earlier one on a tie.  So the counts of a document's
sections add up to its tokens.

Null and empty texts have no tokens and no sections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from . import tokens as tk
from .storage import mapped

SCHEMA = "doc_id bigint, n_chars bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, largest_section bigint, section_tokens array<int>"


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section [bounds[k], bounds[k + 1]) of each token, and whether the token crosses a boundary."""
    a = np.searchsorted(bounds, starts, "right") - 1
    z = np.searchsorted(bounds, ends, "left") - 1
    home, cross = a.copy(), z > a
    for k in np.flatnonzero(cross).tolist():
        edges = np.concatenate([[starts[k]], bounds[a[k] + 1 : z[k] + 1], [ends[k]]])
        home[k] = a[k] + int(np.argmax(np.diff(edges)))
    return home, cross


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per document (`SCHEMA`): its tokens, its lines, and the tokens of each line in order."""
    path = tokenizer or tk.default_path()
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tk.PieceTokenizer.shared(path)
        for b in batches:
            for lo, hi, data, offs in tx.slabs(b.column(1)):
                ids, first = encoder.encode_slab(data, offs)
                ends = np.cumsum(encoder.size[ids])
                starts = ends - encoder.size[ids]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                cuts = np.flatnonzero(data == 10) + 1
                bounds = np.union1d(cuts, offs)  # every row begins a section
                home, cross = allocate(starts, ends, bounds)
                own = np.bincount(home, minlength=len(bounds) - 1).astype(np.int32)
                inside = np.concatenate([[0], np.cumsum(cross)])
                at = np.searchsorted(bounds, offs)
                sections = np.diff(at)
                largest = np.array([own[x:y].max() if y > x else 0 for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                cols = [np.diff(chars[offs]), np.diff(first), sections, np.diff(inside[first]), largest]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in cols), tx.list_array(own, sections, pa.int32())], [f.split()[0] for f in SCHEMA.split(", ")])

    return mapped(own, run, SCHEMA)
