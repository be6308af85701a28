"""Result tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def latex(stats: DataFrame, rows: str, columns: str, order: list[str], cells: list[tuple[str, str]], caption: str = "", label: str = "tab:stats") -> str:
    """A LaTeX table of group statistics: a line a value of ``rows``, for each of ``order`` the ``cells``.

    A cell is (heading, format of the group's fields), such as ("GU", "{gu_mean:.1f} $\\pm$ {gu_std:.1f}"); groups that
    are absent show dashes. ``stats`` has one row a group and is small.
    """
    found = {(r[rows], r[columns]): r.asDict() for r in stats.collect()}
    names = sorted({k[0] for k in found})
    width = len(cells)
    head = " & ".join(f"\\multicolumn{{{width}}}{{c}}{{{c}}}" for c in order)
    sub = " & ".join(h for _ in order for h, _ in cells)
    lines = ["\\begin{table}", "\\centering", f"\\caption{{{caption}}}", f"\\begin{{tabular}}{{l{'c' * width * len(order)}}}", "\\hline", f" & {head} \\\\", f"{rows} & {sub} \\\\", "\\hline"]
    for name in names:
        parts = [f.format(**found[name, c]) if (name, c) in found else "--" for c in order for _, f in cells]
        lines.append(f"{name} & " + " & ".join(parts) + " \\\\")
    return "\n".join([*lines, "\\hline", "\\end{tabular}", f"\\label{{{label}}}", "\\end{table}"])
