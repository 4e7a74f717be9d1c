"""Small pages and charts from result rows; what is rendered is a page of rows
or a curve of a few hundred points, never a table that grows with the corpus."""

from __future__ import annotations

from html import escape


def svg_lines(curves: dict[str, list[tuple[float, float]]], title: str, x: str, y: str, size: int = 567) -> str:
    """Line charts on one pair of axes from 0; 567 pixels are 20 cm at 72 dpi."""
    points = [p for c in curves.values() for p in c]
    right = max((p[0] for p in points), default=0) or 1
    top = max((p[1] for p in points), default=0) or 1
    pad, inner = 50, size - 80
    at = lambda p: f"{pad + inner * p[0] / right:.1f},{size - pad - inner * p[1] / top:.1f}"
    colors = ("#4269d0", "#efb118", "#ff725c", "#3ca951")
    parts = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" font-family="sans-serif" font-size="11">',
        f'<text x="{size / 2}" y="18" text-anchor="middle">{escape(title)}</text>',
        f'<path d="M{pad},{size - pad - inner} V{size - pad} H{pad + inner}" fill="none" stroke="#888"/>',
        f'<text x="{size / 2}" y="{size - 12}" text-anchor="middle">{escape(x)} (0 to {right:g})</text>',
        f'<text x="14" y="{size / 2}" transform="rotate(-90 14 {size / 2})" text-anchor="middle">{escape(y)} (0 to {top:g})</text>',
    ]
    for k, (name, curve) in enumerate(curves.items()):
        color = colors[k % len(colors)]
        parts.append(f'<polyline fill="none" stroke="{color}" stroke-width="1.5" points="{" ".join(map(at, sorted(curve)))}"/>')
        parts.append(f'<text x="{pad + 8}" y="{36 + 14 * k}" fill="{color}">{escape(name)}</text>')
    return "\n".join([*parts, "</svg>"])


def html_table(rows: list[dict]) -> str:
    if not rows:
        return "<p>No rows.</p>"
    head = "".join(f"<th>{escape(str(c))}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def html_page(title: str, *parts: str) -> str:
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>' + "".join(parts)


def results_page(query: str, rows: list[dict], total: int, seconds: float, before: str, after: str) -> str:
    items = "".join(f'<li value="{r["rank"]}"><a href="{escape(r["url"])}">{escape(r["title"] or r["url"])}</a></li>' for r in rows)
    links = "".join(f'<a href="{escape(to)}">{name}</a> ' for name, to in (("Previous", before), ("Next", after)) if to)
    return html_page(f"Results for {query}", f"<p>{total} results, {int(seconds * 1000)} ms</p><ol>{items}</ol>", links)


def document_page(record: dict) -> str:
    """A stored record: its title, then its other fields that have something to show."""
    shown = [(k, v) for k, v in record.items() if k != "title" and v not in (None, "")]
    parts = [f"<h3>{escape(k)}</h3><p>{escape(str(v))}</p>" for k, v in shown]
    return html_page(record.get("title") or f"Document {record.get('doc_id', '')}", *parts)
