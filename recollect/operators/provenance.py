"""How an answer came about, as a small graph of nodes and links."""

from __future__ import annotations

from recollect.operators.graph import to_dot


def of_answer(question: str, answer) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(nodes, links): question -> stages -> candidates (labelled with their score) -> verdict."""
    short = question if len(question) <= 60 else question[:60] + "…"
    stages = ["gate", "recall", "rerank", "judge"]
    nodes = [(short, "query"), *((s, "stage") for s in stages), *((c["id"], "candidate") for c in answer.candidates), (answer.label, "verdict")]
    links = [(a, "then", b) for a, b in zip([short, *stages], stages)]
    links += [("rerank", f"{c['score']:.4f}", c["id"]) for c in answer.candidates]
    links += [(c["id"], "supports", answer.label) for c in answer.candidates] or [("judge", "finds", answer.label)]
    return nodes, links


def dot(question: str, answer) -> str:
    return to_dot(*of_answer(question, answer), name="answer")
