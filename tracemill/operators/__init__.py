"""Operators on sets of reads. Each takes and returns DataFrames or ReadSets and runs no job unless it must refuse."""

from .checks import acceptance, estimate, parity
from .demux import demux, extra
from .flatten import by_run, convert_mixed, flatten, unflatten
from .reads import degrade, get, get_indexed, index, missing, quickcheck, read_ids, repeated, skim, stats, stats_lines, view
from .sets import by_group, cat, group_headers, merge, merge_every, split_chain, split_files, split_groups, split_reads

__all__ = [
    "acceptance", "by_group", "by_run", "cat", "convert_mixed", "degrade", "demux", "estimate", "extra", "flatten", "get", "get_indexed", "group_headers", "index", "merge", "merge_every", "missing", "parity", "quickcheck", "read_ids", "repeated",
    "skim", "split_chain", "split_files", "split_groups", "split_reads", "stats", "stats_lines", "unflatten", "view",
]
