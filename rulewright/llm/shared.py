"""What the operators share: names, batches and memory of tasks; written tables come from ``rulewright.sources.scratch``."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rulewright.sources.scratch import file_system, job_settings, temporary_tables, written  # noqa: F401
from rulewright.sources.scratch import scratch_path as new_path  # noqa: F401

def unique_name(base: str, taken) -> str:
    """``base`` with underscores until it clashes with no column of ``taken`` (case-insensitively)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def text_slices(batch: pa.RecordBatch, most: int = 2_000_000):
    """Slices of a batch of (.., text in the second column) with at most so many bytes of text, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def sorted_groups(batches, columns: tuple[str, ...]):
    """Tables of whole groups from batches sorted by the columns; holds a batch and the group that is open."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        same = np.logical_and.reduce([t[c].to_numpy() == t[c][t.num_rows - 1].as_py() for c in columns])
        cut = 0 if same.all() else t.num_rows - int(same[::-1].argmin())
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Python workers outlive it and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
