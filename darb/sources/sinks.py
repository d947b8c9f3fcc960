"""Result sinks: finite JSON, single CSV files, LaTeX, Markdown and ASCII tables of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities of double columns as null, as JSON has neither."""
    fix = {n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    finite_columns(df).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result (a table of a report) as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def _cells(df: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of over {most} rows is no report")
    return df.columns, [["" if v is None else str(v) for v in r] for r in rows]


def latex_table(df: DataFrame, caption: str = "", wide: bool = False, most: int = 1000) -> str:
    """A tabular environment; characters that LaTeX reads are escaped."""

    def safe(text: str) -> str:
        for a in "&%$#_{}":
            text = text.replace(a, "\\" + a)
        return text.replace("±", "$\\pm$")

    head, rows = _cells(df, most)
    kind = "table*" if wide else "table"
    body = "\n".join(" & ".join(map(safe, r)) + r" \\" for r in rows)
    return f"\\begin{{{kind}}}\n\\caption{{{safe(caption)}}}\n\\begin{{tabular}}{{{'l' * len(head)}}}\n\\hline\n{' & '.join(map(safe, head))} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{{kind}}}\n"


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    head, rows = _cells(df, most)
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
    return "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)])


def ascii_table(df: DataFrame, most: int = 1000) -> str:
    head, rows = _cells(df, most)
    width = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, width)) + "|"
    return "\n".join([rule, line(head), rule, *map(line, rows), rule])
