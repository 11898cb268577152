"""Which inventory rows are covered by what.

``by_row`` joins three sources: the rows named at each query, functions that
have no query of their own (tested in tests/), and rows that are left out.
"""

from __future__ import annotations

from . import registry

#: Rows that a library function covers without a query over the relational tables.
FUNCTIONS = {
    "sources.tree.entries": (1, 5),
    "sources.tree.contents": (6, 7, 8),
    "sources.syntax.tables": (4,),
    "operators.workspace.package_roots": (2,),
    "operators.workspace.members": (3,),
    "sources.python_source.extract": (10, 11, 14, 24, 314, 450),
    "sources.python_source.uses": (12, 27),
    "sources.python_source.external": (13,),
    "sources.syntax.nodes": (18,),
    "operators.ways_in.in_project": (19,),
    "operators.ways_in.all_ways": (17,),
    "sources.facts.read": (36, 50, 52, 53),
    "sources.facts.write": (181, 400, 406, 407),
    "sources.facts.strip_comments": (35,),
    "functions.text.glob_pattern": (30, 84),
    "functions.text.headings": (253,),
    "functions.text.identifier_at": (247,),
    "functions.text.opening": (236,),
    "functions.text.overlap_area": (259,),
    "functions.text.polyline_length": (261,),
    "streaming.live.debounce_stream": (290, 291, 292),
    "streaming.live.follow_batches": (294,),
    "operators.review.submit": (287, 309),
    "operators.decisions.answer_problems": (288,),
    "operators.decisions.spread": (322,),
    "operators.decisions.refused": (323,),
    "operators.drafts.read_answers": (349,),
    "sources.snapshots.SnapshotStore.files": (37, 47),
    "sources.snapshots.SnapshotStore.model": (42,),
    "streaming.events.fold_stream": (293, 295, 297),
    "operators.diff.keyed": (122, 123, 188, 284),
    "operators.diff.surface": (191, 192),
    "operators.claims.sdk_of": (31, 79),
}
#: User interface, network, process or file side effects, and layout search: not built.
LEFT_OUT = {
    "user interface or text output": (281, 385, 387, 388, 401, 402, 403, 408, 409, 410, 411, 412, 414, 415, 448, 451, 454, 460, 462, 463, 464, 474),
    "network providers and external commands": (48, 318, 319, 320, 321, 325, 326, 328, 331, 465, 466, 467, 468, 469),
    "file locks and process plumbing": (38, 39, 49, 182, 413, 455),
    "layout and routing search (one figure at a time, no data-parallel form)": (177, 179, 218, 219, 220, 221, 222, 386, 461),
    "needs a parser that is not installed": (26, 33, 34, 251),
}


def by_row() -> dict[int, str]:
    """Row number to what covers it; rows without an entry are open."""
    registry.queries()
    found = {r: f"left out: {why}" for why, rows in LEFT_OUT.items() for r in rows}
    found |= {r: name for name, rows in FUNCTIONS.items() for r in rows}
    for q in registry.QUERIES.values():
        found |= {r: f"query {q.name}" for r in q.rows}
    return found


def open_rows(last: int = 474) -> list[int]:
    return [r for r in range(1, last + 1) if r not in by_row()]
