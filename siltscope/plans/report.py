"""Reports of one project, as JSON or text."""

from __future__ import annotations

import json

from siltscope.plans.analyzer import Analysis


def report(analysis: Analysis, with_complexity: bool = False) -> dict:
    """The report's tree. A report holds one project's full lists, so its rows come to the driver."""
    row = analysis.rating.first()
    found = {"dsa": {}, "design": {}}
    for p in sorted(analysis.pattern_files.collect(), key=lambda p: (p.first_ordinal, p.pattern_ord)):
        found[p.category][p.pattern] = {"files": p.files, "description": p.description}
    names = ("dsa_score", "design_score", "complexity_bonus", "dsa_patterns_count", "design_patterns_count", "files_scanned", "total_lines")
    out = {"project": row.project, "rating": row.rating, "label": row.label, "breakdown": {k: row[k] for k in names}, "dsa_patterns": found["dsa"], "design_patterns": found["design"]}
    if with_complexity:
        s = analysis.summary.first().asDict(recursive=True)
        del s["project"]
        for k in ("time_complexity_distribution", "space_complexity_distribution"):
            s[k] = dict(sorted((s[k] or {}).items()))
        out["complexity"] = s if s["total_functions"] else {"total_functions": 0}
    return out


def to_json(tree: dict) -> str:
    return json.dumps(tree, indent=2)


def color_of(rating: float) -> str:
    return "red" if rating < 4 else "yellow" if rating < 7 else "green"


def table(title: str, head: list[str], rows: list[list[str]]) -> list[str]:
    widths = [max(len(str(r[i])) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "  ".join(str(c).ljust(w) for c, w in zip(r, widths)).rstrip()
    return [*([title] if title else []), line(head), line(["-" * w for w in widths]), *map(line, rows)]


def to_text(tree: dict, verbose: bool = False, paint: bool = False) -> str:
    codes = {"red": 31, "yellow": 33, "green": 32}
    colored = lambda s, c: f"\x1b[1;{codes[c]}m{s}\x1b[0m" if paint else s
    b = tree["breakdown"]
    out = ["", f"Analyzing: {tree['project']}", "", "Quality Rating", colored(f"{tree['rating']}/10", color_of(tree["rating"])), tree["label"], ""]
    out += [f"Files scanned: {b['files_scanned']} | Lines: {b['total_lines']}", f"DSA Score: {b['dsa_score']} | Design Score: {b['design_score']}", ""]
    for key, title in (("dsa_patterns", "DSA Patterns Detected"), ("design_patterns", "System Design Patterns Detected")):
        if tree[key]:
            rows = []
            for name, p in tree[key].items():
                rows.append([name, p["description"], len(p["files"])])
                rows += [["", f"  └─ {f}", ""] for f in p["files"][:3] if verbose]
            out += [*table(title, ["Pattern", "Description", "Files"], rows), ""]
    if not tree["dsa_patterns"] and not tree["design_patterns"]:
        out.append("No significant patterns detected.")
    if c := tree.get("complexity"):
        out += ["", "Complexity Analysis", f"Functions analyzed: {c['total_functions']}", f"Avg confidence: {c.get('average_confidence', 0) * 100:.0f}%"]
        for key, title in (("time_complexity_distribution", "Time Complexity Distribution"), ("space_complexity_distribution", "Space Complexity Distribution")):
            if c.get(key):
                out += [*table(title, ["Complexity", "Count"], [[k, n] for k, n in c[key].items()]), ""]
        if n := c.get("high_complexity_count", 0):
            high = c["high_complexity_functions"]
            out += ["", f"⚠ {n} high-complexity function(s):", *table("", ["Function", "File", "Time", "Space", "Confidence"], [[f["name"], f["file"], f["time"], f["space"], f"{f['confidence']:.0%}"] for f in high[:10]])]
            if verbose:
                out += ["", "Reasoning for high-complexity functions:"]
                for f in high[:5]:
                    out += ["", f"{f['name']} ({f['file']})", *(f"  • {r}" for r in f["reasoning"])]
    return "\n".join(out)
