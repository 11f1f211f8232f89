"""Settings of the engine, by part. All are plain values that a caller may replace."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Running headers and footers that extraction drops, and the words that tell a monospaced font.
HEADER_FOOTER = (
    r"^Page\s+\d+\s+of\s+\d+$",
    r"^Document\s+\d+\s+of\s+\d+$",
    r"^SENIOR AI ENGINEER TECHNICAL ASSESSMENT.*$",
    r"^SENIOR AI ENGINEER ASSESSMENT.*$",
    r"^S E N I O R\s+A I\s+E N G I N E E R.*$",
    r"^Assessment Assignment\s+\|\s+Page\s+\d+\s+of\s+\d+$",
    r"^Vector Database Comparison\s+\|\s+Document\s+\d+\s+of\s+\d+.*$",
    r"^Agentic AI Frameworks\s+—\s+Document\s+\d+\s+of\s+\d+.*$",
    r"^Page\s+\d+(\s+of\s+\d+)?$",
)
CODE_FONTS = ("mono", "courier", "consolas", "code", "dejavu-sans-mono", "noto-sans-mono")


@dataclass(frozen=True)
class Layout:
    """Extraction of elements from page layout. bold_mask: the bits of a span's flags that mean bold."""

    heading_size: float = 11.5
    min_rows: int = 2
    min_cols: int = 2
    min_filled: float = 0.35
    max_cell: int = 350
    covered: float = 0.4
    bold_mask: int = 2
    header_footer: tuple[str, ...] = HEADER_FOOTER
    code_fonts: tuple[str, ...] = CODE_FONTS


@dataclass(frozen=True)
class Chunking:
    """Token budgets of chunks."""

    target: int = 400
    most: int = 600
    overlap: int = 50
    breadcrumbs: bool = True


@dataclass(frozen=True)
class Retrieval:
    """BM25 (Robertson and Zaragoza 2009, with a floor for negative idf), rank fusion and the relevance threshold."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    top_k: int = 5
    overfetch: int = 3
    rrf_k: int = 60
    min_score: float = 0.015


@dataclass(frozen=True)
class Routing:
    """Weights of the complexity features, in rubric order, and the score from which a question takes several steps."""

    threshold: int = 2
    # The rubric's features and weights.
    weights: tuple[tuple[str, int], ...] = (
        ("direct factual question", 0),
        ("requires one focused retrieval", 0),
        ("requires comparison", 2),
        ("requires multiple independent facts", 2),
        ("requires multiple documents", 2),
        ("requires query decomposition", 2),
        ("requires calculations or external tools", 3),
        ("requires iterative search", 3),
        ("requires planning or multi-step reasoning", 3),
    )


@dataclass(frozen=True)
class Agent:
    """Limits of the multi-step workflow: sub-questions, rewrites of each, hits of each search, sources audited."""

    sub_questions: int = 4
    rewrites: int = 2
    top_k: int = 3
    audited: int = 8


LAYOUT, CHUNKING, RETRIEVAL, ROUTING, AGENT = Layout(), Chunking(), Retrieval(), Routing(), Agent()


def configured(kind: type, spark=None, environment: Mapping[str, str] = os.environ):
    """A group of settings with what the session's spark.docquarry.<group>.<name>, or else the environment's
    DOCQUARRY_<GROUP>_<NAME>, says of its numbers, flags and strings; a value of another type raises ValueError."""
    found = {}
    for f in fields(kind):
        raw = spark.conf.get(f"spark.docquarry.{kind.__name__.lower()}.{f.name}", None) if spark is not None else None
        raw = environment.get(f"DOCQUARRY_{kind.__name__}_{f.name}".upper()) if raw is None else raw
        if raw is not None and type(f.default) in (int, float, bool, str):
            if isinstance(f.default, bool) and raw.lower() not in ("true", "false"):
                raise ValueError(f"{f.name} is true or false, not {raw}")
            found[f.name] = raw.lower() == "true" if isinstance(f.default, bool) else type(f.default)(raw)
    return kind(**found)
