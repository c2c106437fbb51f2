"""Reports of a comparison: JSON, plain text and one self-contained HTML page; and gates on its numbers."""

from __future__ import annotations

import html
import json
import math
from dataclasses import asdict, dataclass

from mirrorframe.operators.quality import QualityReport

#: Upper ends of the verdict bands of a marginal or correlation distance.
BANDS = ((0.05, "excellent"), (0.1, "good"), (0.2, "fair"))


def _plain(x: object) -> object:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def to_json(report: QualityReport) -> str:
    """All numbers; those that aren't finite are null."""
    return json.dumps(_plain(asdict(report)), indent=2, ensure_ascii=False)


def verdict(x: float) -> str:
    if not math.isfinite(x):
        return "unknown"
    return next((name for top, name in BANDS if x <= top), "poor")


def _number(x: float | None) -> str:
    return "n/a" if x is None or not math.isfinite(x) else f"{x:.4f}"


def to_text(report: QualityReport, worst: int = 10) -> str:
    """The report for a terminal."""
    d = report.dcr
    lines = [
        f"rows             real {report.n_real}, synthetic {report.n_synth}",
        f"mean marginal    {_number(report.avg_marginal)} ({verdict(report.avg_marginal)})",
        f"correlation gap  {_number(report.correlation_distance)} ({verdict(report.correlation_distance)})",
        "closest record   " + ", ".join(f"{k.removeprefix('dcr_')} {_number(v)}" for k, v in d.items()),
        "",
        "worst columns",
    ]
    lines += [f"  {m['column']:<28} {m['metric']:<9} {_number(m['score']):>8}   nulls {_number(m['real_null_rate'])} / {_number(m['synth_null_rate'])}" for m in report.worst(worst)]
    for title, rows in (("calendar", [f"{c['column']} {c['feature']}: {_number(c['score'])}" for c in report.calendar]), ("types that differ", [f"{c}: {a} / {b}" for c, a, b in report.dtype_mismatches]), ("broken orders of counts", [f"{i['low']} <= {i['high']}: {i['violations']}" for i in report.invariants])):
        if rows:
            lines += ["", title] + [f"  {r}" for r in rows]
    return "\n".join(lines) + "\n"


def _table(head: list[str], rows: list[list[str]]) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape(v)}</{tag}>"
    return "<table><tr>" + "".join(cell("th", h) for h in head) + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>"


def _heat(title: str, pairs: dict[tuple[str, str], float], names: list[str]) -> str:
    def shade(a: str, b: str) -> str:
        x = 1.0 if a == b else pairs.get((a, b), pairs.get((b, a), 0.0))
        return f'<td title="{html.escape(a)}, {html.escape(b)}: {x:.3f}" style="background:rgba(20,90,160,{min(1.0, abs(x)):.2f})"></td>'

    body = "".join(f"<tr><th>{html.escape(a)}</th>" + "".join(shade(a, b) for b in names) + "</tr>" for a in names)
    return f"<h3>{html.escape(title)}</h3><table class=heat>{body}</table>"


def to_html(report: QualityReport, title: str = "Comparison") -> str:
    """One page without outside resources."""
    cards = "".join(f"<div class=card><b>{html.escape(k)}</b><span>{_number(v)}</span><i>{verdict(v) if banded else ''}</i></div>" for k, v, banded in (("mean marginal", report.avg_marginal, True), ("correlation gap", report.correlation_distance, True), ("closest record, 5%", report.dcr.get("dcr_p5", math.nan), False)))
    bars = "".join(f"<div class=bar><label>{html.escape(m['column'])}</label><div style=\"width:{100 * min(1.0, m['score'] or 0) if m['score'] is not None and math.isfinite(m['score']) else 0:.1f}%\"></div><em>{m['metric']} {_number(m['score'])}</em></div>" for m in report.worst(len(report.marginals)))
    names = list(dict.fromkeys(x for r in report.associations_real for x in (r["a"], r["b"])))
    real, synth = ({(r["a"], r["b"]): r["score"] for r in rows} for rows in (report.associations_real, report.associations_synth))
    gap = {k: abs(v - synth.get(k, 0.0)) for k, v in real.items()}
    sections = [f"<div class=cards>{cards}</div>", "<h2>Columns</h2>", bars]
    if names:
        sections += ["<h2>Associations</h2>", _heat("real", real, names), _heat("synthetic", synth, names), _heat("difference", gap, names)]
    if report.calendar:
        sections += ["<h2>Calendar</h2>", _table(["column", "feature", "KS"], [[c["column"], c["feature"], _number(c["score"])] for c in report.calendar])]
    sections += ["<h2>Distance to the closest record</h2>", _table(list(report.dcr), [[_number(v) for v in report.dcr.values()]])]
    issues = [[c, f"type {a} / {b}"] for c, a, b in report.dtype_mismatches] + [[f"{i['low']} <= {i['high']}", f"{i['violations']} rows"] for i in report.invariants]
    if issues:
        sections += ["<h2>Issues</h2>", _table(["where", "what"], issues)]
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;text-align:left}.heat td{width:18px;height:18px;padding:0}.cards{display:flex;gap:1em}.card{border:1px solid #bbb;padding:1em}.card span{display:block;font-size:1.6em}.bar label{display:inline-block;width:14em}.bar div{display:inline-block;background:#246;height:.7em;max-width:30em}"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(title)}</h1><p>{report.n_real} real rows, {report.n_synth} synthetic</p>" + "".join(sections)


@dataclass(frozen=True)
class Gates:
    """Limits; None asks for nothing."""

    max_marginal: float | None = None
    max_correlation: float | None = None
    min_dcr: float | None = None
    max_verbatim: float | None = None

    @property
    def any(self) -> bool:
        return any(v is not None for v in vars(self).values())


@dataclass(frozen=True)
class Breach:
    gate: str
    value: float
    limit: float | None


def breaches(report: QualityReport, gates: Gates) -> list[Breach]:
    """Limits that are broken; a number that isn't finite breaks its limit, and type or count issues break any set of gates."""
    out = []
    verbatim = [m["score"] for m in report.marginals if m["metric"] == "verbatim" and m["score"] is not None]
    checks = [
        ("max_marginal", report.avg_marginal, gates.max_marginal, 1),
        ("max_correlation", report.correlation_distance, gates.max_correlation, 1),
        ("min_dcr", report.dcr.get("dcr_p5", math.nan), gates.min_dcr, -1),
        ("max_verbatim", max(verbatim, default=0.0), gates.max_verbatim, 1),
    ]
    for name, value, limit, sign in checks:
        if limit is not None and (not math.isfinite(value) or sign * value > sign * limit):
            out.append(Breach(name, value, limit))
    if gates.any:
        out += [Breach(f"type of {c}", math.nan, None) for c, _, _ in report.dtype_mismatches]
        out += [Breach(f"{i['low']} <= {i['high']}", i["violations"], None) for i in report.invariants]
    return out


def summary_line(report: QualityReport, leak: float = 0.1, hints: int = 3) -> str:
    """One line: marginal, correlation, closest record, and the texts most often taken over word for word."""
    leaks = sorted(((m["score"], m["column"]) for m in report.marginals if m["metric"] == "verbatim" and (m["score"] or 0) > leak), key=lambda x: (-x[0], x[1]))
    line = f"quality: marginal {_number(report.avg_marginal)}, correlation {_number(report.correlation_distance)}, dcr_p5 {_number(report.dcr.get('dcr_p5'))}, leaks {len(leaks)}"
    return line + ("; " + ", ".join(f"{c} {s:.0%} verbatim" for s, c in leaks[:hints]) if leaks else "")
