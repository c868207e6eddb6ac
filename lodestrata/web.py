"""A thin HTTP face: a search page, /api/search and /api/stats, on one long-lived session."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .config import Config
from .plans import engine

PAGE = """<!doctype html><meta charset="utf-8"><title>Search</title>
<form id="f"><input id="q" size="60" autofocus> <label><input type="checkbox" id="a"> answer</label> <button>Search</button></form>
<p id="s"></p><p id="w"></p><ol id="r"></ol>
<script>
const el = id => document.getElementById(id);
const add = (to, tag, text) => { const x = document.createElement(tag); x.textContent = text; to.append(x); return x; };
el("f").onsubmit = async e => {
  e.preventDefault();
  const got = await (await fetch(`/api/search?q=${encodeURIComponent(el("q").value)}&answer=${el("a").checked ? 1 : 0}`)).json();
  el("w").textContent = got.answer || "";
  el("r").replaceChildren();
  for (const h of got.hits) { const li = add(el("r"), "li", ""); add(li, "b", h.title); add(li, "div", h.provenance); add(li, "div", h.snippet); add(li, "small", h.why); }
};
const tick = async () => { const s = await (await fetch("/api/stats")).json(); el("s").textContent = `${s.records} records, ${s.updated}${s.watching ? ", watching" : ""}`; };
tick(); setInterval(tick, 3000);
</script>"""


def handler(spark, cfg: Config) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: bytes, kind: str, status: int = 200) -> None:
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, value, status: int = 200) -> None:
            self._send(json.dumps(value, ensure_ascii=False, default=str).encode(), "application/json", status)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            args = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if url.path in ("/", "/index.html"):
                self._send(PAGE.encode(), "text/html")
            elif url.path == "/api/search":
                wants = args["answer"] == "1" if "answer" in args else cfg.answer
                found = engine.search(spark, cfg.index, args.get("q", ""), embedder=cfg.embedder, answer=wants)
                self._json({"query": found.query, "answer": found.answer, "hits": [h.asDict() for h in found.hits]})
            elif url.path == "/api/stats":
                index = engine.open_index(spark, cfg.index)
                figures = engine._summary(index, index.meta()) if index.exists() else {"count": 0, "embedder": None}
                at = index.updated()
                self._json({**figures, "records": figures["count"], "updated": time.strftime("%H:%M:%S", time.localtime(at)) if at else "—", "watching": cfg.watching})
            else:
                self._json({"error": "not found"}, 404)

        def log_message(self, *args) -> None:
            pass

    return Handler


def server(spark, cfg: Config) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((cfg.host, cfg.port), handler(spark, cfg))


def serve(spark, cfg: Config) -> None:
    with server(spark, cfg) as s:
        print(f"http://{cfg.host}:{s.server_address[1]}")
        s.serve_forever()
