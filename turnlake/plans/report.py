"""Text reports of small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a frame; a report shows a page, not a table."""
    found = df.limit(rows).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in found)])


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    parts = [f"# {title}"]
    for name, content in sections.items():
        parts += [f"## {name}", content if isinstance(content, str) else markdown_table(content)]
    return "\n\n".join(parts) + "\n"


def interpretation(coefficients: list[dict], level: float = 0.05) -> str:
    """One line a coefficient: its sign and whether it stands out."""
    said = []
    for r in coefficients:
        if r["term"] != "Intercept":
            sure = "significant" if r["p"] < level else "not significant"
            said.append(f"- {r['term']}: {'positive' if r['coef'] > 0 else 'negative'} ({r['coef']:.4f}), {sure} at {level:g}")
    return "\n".join(said)
