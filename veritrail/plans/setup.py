"""A project folder, checks of its set-up, and a small page to run work from."""

from __future__ import annotations

import importlib.util
import json
import os
import secrets
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from ..sources.settings import parse_yaml
from .jobs import Busy, Jobs

ADAPTER = '''"""Your pipeline: answer a question, and tell which passages were found."""


def query(question: str) -> dict:
    return {"answer": "", "retrieved_chunk_ids": [], "contexts": []}
'''
SPACE = "knobs:\n  k: {min: 1, max: 5, step: 1}\nbaseline:\n  k: 3\n"


def init(folder: str) -> list[str]:
    """Writes the template files that aren't there yet, and returns their names; nothing is overwritten."""
    root, made = Path(folder), []
    for name, text in (("adapter.py", ADAPTER), ("search_space.yaml", SPACE), ("docs/README.md", "Put .txt and .md files here.\n"), (".env", "MODEL_URL=\nMODEL_NAME=\nMODEL_KEY=\n")):
        path = root / name
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
            made.append(name)
    return made


def load_adapter(path: str):
    """What a user file offers: ``adapter``, else ``query``; ValueError if it has neither or does not load."""
    spec = importlib.util.spec_from_file_location("user_adapter", path)
    if spec is None:
        raise ValueError(f"{path} is no Python file")
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as why:
        raise ValueError(f"{path} does not load: {why}") from why
    for name in ("adapter", "query"):
        if hasattr(module, name):
            return getattr(module, name)
    raise ValueError(f"{path} has neither adapter nor query")


def doctor(folder: str) -> list[dict]:
    """``check, ok, note`` of the things that a run needs."""
    root = Path(folder)

    def documents() -> str:
        n = sum(1 for p in (root / "docs").rglob("*") if p.suffix.lower() in (".txt", ".md"))
        if not n:
            raise ValueError("no .txt or .md files in docs")
        return f"{n} files"

    def writable() -> str:
        if not os.access(root, os.W_OK):
            raise ValueError("the folder can't be written")
        return str(root)

    def java() -> str:
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
        if session is None:
            raise ValueError("no Spark session")
        return f"Spark {session.version}"

    checks: dict[str, Callable[[], object]] = {
        "python": lambda: sys.version.split()[0],
        "spark": java,
        "folder": writable,
        "documents": documents,
        "adapter": lambda: type(load_adapter(str(root / "adapter.py"))).__name__,
        "search space": lambda: sorted(parse_yaml((root / "search_space.yaml").read_text())["knobs"]),
    }
    out = []
    for name, check in checks.items():
        try:
            out.append({"check": name, "ok": True, "note": str(check())})
        except Exception as why:
            out.append({"check": name, "ok": False, "note": str(why)})
    return out


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Veritrail</title></head><body><h1>Veritrail</h1>
<button onclick="send('run')">Run</button> <button onclick="send('cancel')">Cancel</button><pre id="state"></pre><script>
const key = new URLSearchParams(location.search).get("key");
const call = (path, method) => fetch(path, {method, headers: {"X-Key": key}}).then(r => r.json());
const show = () => call("/state", "GET").then(s => { document.getElementById("state").textContent = JSON.stringify(s, null, 1); });
const send = path => call("/" + path, "POST").then(show);
setInterval(show, 1000); show();
</script></body></html>"""


def serve(folder: str, jobs: Jobs, work: Callable, port: int = 0) -> tuple[ThreadingHTTPServer, str]:
    """A server on this machine only, and its address with the key that every request must carry.

    The page starts ``work(job)``, shows its progress and cancels it; ``/doctor`` checks the folder.
    """
    key = secrets.token_urlsafe(16)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            """Requests carry the key, so they are not logged."""

        def answer(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def tell(self, status: int, value) -> None:
            self.answer(status, json.dumps(value, default=str).encode())

        def known(self) -> bool:
            host = self.headers.get("Host", "").rsplit(":", 1)[0]
            if host in ("127.0.0.1", "localhost") and secrets.compare_digest(self.headers.get("X-Key", ""), key):
                return True
            self.tell(403, {"error": "refused"})
            return False

        def do_GET(self) -> None:
            if self.path.split("?")[0] == "/":
                self.answer(200, PAGE.encode(), "text/html; charset=utf-8")
            elif self.known():
                found = {"/state": lambda: jobs.current and jobs.current.view(), "/doctor": lambda: doctor(folder)}.get(self.path)
                self.tell(200, found()) if found else self.tell(404, {"error": "not found"})

        def do_POST(self) -> None:
            if not self.known():
                return
            if self.path == "/run":
                try:
                    self.tell(200, jobs.start("check", work).view())
                except Busy as why:
                    self.tell(409, {"error": str(why)})
            elif self.path == "/cancel":
                self.tell(200, {"cancelled": jobs.cancel()})
            else:
                self.tell(404, {"error": "not found"})

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    return server, f"http://127.0.0.1:{server.server_port}/?key={key}"
