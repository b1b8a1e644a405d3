"""Plain-text rendering of results. Only bounded result tables are rendered."""

from __future__ import annotations

from lodestone.operators.metrics import METRICS

# Size units, colour bands, column headings of the metric table.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
SCORE_BANDS = ((0.8, "green"), (0.5, "yellow"), (float("-inf"), "red"))
METRIC_TITLES = ("Recall@1", "Recall@5", "Recall@10", "MRR", "NDCG@10")


def score_style(score: float) -> str:
    """Colour of a score."""
    return next(colour for least, colour in SCORE_BANDS if score >= least)


def format_size(count: float) -> str:
    """Byte count with one decimal, in the largest unit that keeps it at 1 or more."""
    step = 0
    while step + 1 < len(SIZE_UNITS) and count >= 1024 ** (step + 1):
        step += 1
    return f"{count / 1024**step:.1f}{SIZE_UNITS[step]}"


def format_result(position: int, row: dict) -> str:
    """One search result: scores, place and code."""
    name = ".".join(p for p in (row.get("class_name"), row.get("function_name")) if p)
    lines = [
        f"Result {position}",
        f"  Score:     {row['final_score']:.4f} ({score_style(row['final_score'])})",
        f"  File:      {row['file_path']}",
        f"  Function:  {name or '<anonymous>'}",
        f"  Language:  {row['language'].capitalize()}",
        f"  Lines:     {row['start_line']}–{row['end_line']}",
    ]
    if row.get("reranker_score") is not None:
        lines.append(
            f"  Reranker:  {row['reranker_score']:.4f}  |  Embed: "
            f"{row['embedding_similarity']:.4f}  |  Meta: {row['metadata_bonus']:.4f}"
        )
    return "\n".join([*lines, "  Code:", *("    " + x for x in row["source_code"].splitlines())])


def format_metrics(rows: list[dict], by: str = "language") -> str:
    """Metric table; missing values show as zero and the overall row comes last."""
    ordered = sorted(rows, key=lambda r: (r[by] == "overall", r[by]))
    out = [f"{'Language':<12}" + "".join(f"{t:>11}" for t in METRIC_TITLES)]
    for row in ordered:
        out.append(f"{row[by]:<12}" + "".join(f"{row.get(m) or 0.0:>11.4f}" for m in METRICS))
    return "\n".join(out)


def format_index_summary(path: str, vectors: int, dimension: int, languages=None) -> str:
    lines = [f"Path:       {path}", f"Vectors:    {vectors:,}", f"Dimension:  {dimension}"]
    if languages:
        lines.append("Languages:  " + ", ".join(languages))
    return "\n".join(lines)
