"""A small HTTP front end over corpora: search, documents, statistics, build
figures, latencies and evaluation."""

from __future__ import annotations

import json
import time
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np

from quarry.operators import evaluate
from quarry.operators.index import WEIGHT_NAMES
from quarry.plans import render
from quarry.plans.corpus import Corpus, Judged

LATENCIES = 10_000  # the last ones of a corpus are kept
QUANTILES = (0.5, 0.9, 0.95, 0.99)


class Site:
    """Answers to addresses; the server only carries them."""

    def __init__(self, corpora: dict[str, Corpus], judged: Judged | None = None):
        self.corpora, self.judged = corpora, judged
        self.latencies: dict[str, deque[float]] = {name: deque(maxlen=LATENCIES) for name in corpora}
        self._stats: dict[str, list[dict]] = {}  # an index doesn't change
        self._heaps: dict[str, str] = {}

    def get(self, address: str) -> tuple[int, str, str]:
        """Status, content type and body."""
        url = urlsplit(address)
        match [p for p in url.path.split("/") if p]:
            case []:
                return self._search({k: v[0] for k, v in parse_qs(url.query).items()})
            case ["stat"]:
                rows = [r for name in self.corpora for r in self._stat(name)]
                links = [f'<p><a href="/heaps/{render.escape(name)}">Vocabulary of {render.escape(name)}</a></p>' for name in self.corpora]
                return self._html("Corpus statistics", render.html_table(rows), *links)
            case ["heaps", name] if name in self.corpora:
                return self._svg(self._growth(name))
            case ["perf"]:
                return self._html("Build figures", render.html_table([c.perf for c in self.corpora.values() if c.perf]))
            case ["latency"]:
                return self._html("Search times", render.html_table([self._quantiles(name) for name in self.corpora]))
            case ["doc", number] if number.isdigit():
                return self._document(list(self.corpora), int(number))
            case ["doc", name, number] if name in self.corpora and number.isdigit():
                return self._document([name], int(number))
            case ["precall"] if self.judged is not None:
                return self._svg(self._curves(self.judged.mean, "Average precision by recall"))
            case ["qrels"] if self.judged is not None:
                return self._topics()
            case ["qrels", qid] if self.judged is not None and qid.isdigit():
                return self._svg(self._curves(self.judged.curves.filter(f"qid = {int(qid)}"), f"Precision by recall, topic {qid}"))
        return (404, "text/plain", "not found")

    def _html(self, title: str, *parts: str) -> tuple[int, str, str]:
        return (200, "text/html; charset=utf-8", render.html_page(title, *parts))

    def _svg(self, drawn: str) -> tuple[int, str, str]:
        return (200, "image/svg+xml", drawn)

    def _stat(self, name: str) -> list[dict]:
        if name not in self._stats:
            self._stats[name] = [r.asDict() for r in self.corpora[name].stats().collect()]
        return self._stats[name]

    def _growth(self, name: str) -> str:
        if name not in self._heaps:
            rows = self.corpora[name].heaps().collect()  # 100 points
            self._heaps[name] = render.svg_lines({name: [(r.tokens, r.vocabulary) for r in rows]}, "Vocabulary", "tokens", "distinct terms")
        return self._heaps[name]

    def _quantiles(self, name: str) -> dict:
        seen = list(self.latencies[name])
        found = np.quantile(seen, QUANTILES) if seen else [None] * len(QUANTILES)
        shown = {f"p{round(p * 100)} ms": None if v is None else int(v * 1000) for p, v in zip(QUANTILES, found)}
        return {"corpus": name, "searches": len(seen), **shown}

    def _document(self, names: list[str], number: int) -> tuple[int, str, str]:
        for name in names:
            if (record := self.corpora[name].document(number)) is not None:
                return (200, "text/html; charset=utf-8", render.document_page(record))
        return (404, "text/plain", "no such document")

    def _curves(self, rows, title: str) -> str:
        points = rows.collect()  # 256 points a weight
        lines = {w: [(r.i / evaluate.SAMPLES, r.precision) for r in points if r.weight == w] for w in WEIGHT_NAMES}
        return render.svg_lines({WEIGHT_NAMES[w]: line for w, line in lines.items() if line}, title, "recall", "precision")

    def _topics(self) -> tuple[int, str, str]:
        """The topics that have a curve, each with a link to it; and the report."""
        valid = self.judged.curves.select("qid").distinct()
        rows = self.judged.topics.join(valid, "qid").orderBy("qid").collect()  # the topics of an evaluation
        items = "".join(f'<li value="{r.qid}"><a href="/qrels/{r.qid}">{render.escape(r.text)}</a></li>' for r in rows)
        report = render.html_table([r.asDict() for r in self.judged.report.orderBy("weight").collect()])
        return self._html("Judged topics", report, '<p><a href="/precall">Average</a></p>', f"<ol>{items}</ol>")

    def _search(self, asked: dict[str, str]) -> tuple[int, str, str]:
        query, corpus = asked.get("query", ""), self.corpora.get(asked.get("corpus") or next(iter(self.corpora), ""))
        kind = asked.get("type", "vectorial")
        if not query or corpus is None or kind not in ("vectorial", "boolean"):
            return self._html("Search", '<form><input name="query"><button>Search</button></form>')
        began = time.perf_counter()
        page = corpus.search(query, kind, asked.get("weight"), asked.get("offset"))
        rows = [r.asDict() for r in page.rows.orderBy("rank").collect()]
        seconds = time.perf_counter() - began
        self.latencies.setdefault(corpus.name, deque(maxlen=LATENCIES)).append(seconds)
        name = next(n for n, c in self.corpora.items() if c is corpus)
        for r in rows:  # a document's own page names its corpus
            r["url"] = f"/doc/{name}/{r['doc_id']}" if r["url"].startswith("/doc/") else r["url"]
        return (200, "text/html; charset=utf-8", render.results_page(query, rows, page.total, seconds, page.previous, page.next))


def site_of(spark, paths: list[str]) -> Site:
    """The site of saved indexes, with the first saved evaluation among them."""
    corpora = {c.name: c for c in (Corpus.load(spark, p) for p in paths)}
    return Site(corpora, next((j for p in paths if (j := Judged.load(spark, p)) is not None), None))


def serve(site: Site, port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, kind, body = site.get(self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)
