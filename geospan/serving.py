"""A small service over the registries and models that a program hands it, with the standard library's server.

``GET /health``, ``/capabilities`` and ``/models`` list; ``POST /detect/{id}`` and
``/segment/{id}`` take ``{"height", "width", "data"}`` (a flat image) and answer
boxes or a mask; ``POST /infer/{id}`` answers whatever the model makes of
``{"data"}``. For tables, use the operators: a request is one image.
"""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np

from geospan import zoo

#: Most bytes of a request.
MOST_BYTES = 10 * 1024 * 1024


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class Service:
    """Models by task and id; ``api_key``: what requests must send as ``X-API-Key``, if anything."""

    def __init__(self, api_key: str | None = None, threshold: float = 0.5):
        self.api_key, self.threshold = api_key, threshold
        self.models: dict[str, dict[str, Callable]] = {"detect": {}, "segment": {}, "infer": {}}

    def add(self, task: str, model_id: str, model: Callable) -> Service:
        self.models[task][model_id] = model
        return self

    def get(self, path: str) -> dict:
        if path == "/health":
            return {"status": "healthy"}
        if path == "/capabilities":
            return {"capabilities": list(zoo.CAPABILITIES.rows.values())}
        if path == "/models":
            return {"models": list(zoo.MODELS.rows.values()), "loaded": {task: sorted(known) for task, known in self.models.items()}}
        raise Refused(404, "no such path")

    def post(self, path: str, body: dict) -> dict:
        task, _, model_id = path.strip("/").partition("/")
        model = self.models.get(task, {}).get(model_id)
        if model is None:
            raise Refused(404, f"no such model: {path}")
        if "data" not in body:
            raise Refused(422, "data is missing")
        if task == "infer":
            return {"model_id": model_id, "output": np.asarray(model(np.asarray(body["data"], float))).tolist()}
        try:
            image = np.asarray(body["data"], float).reshape(int(body["height"]), int(body["width"]))
        except (KeyError, TypeError, ValueError) as error:
            raise Refused(422, "height and width must fit the data") from error
        if task == "segment":
            return {"model_id": model_id, "mask": np.asarray(model(image)).astype(int).tolist()}
        least = float(body.get("threshold", self.threshold))
        names = ("class_id", "confidence", "x1", "y1", "x2", "y2")
        return {"model_id": model_id, "detections": [dict(zip(names, map(float, box), strict=True)) for box in model(image) if box[1] >= least]}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, make: Callable[[], dict]) -> None:
            try:
                if service.api_key is not None and not hmac.compare_digest(self.headers.get("X-API-Key", ""), service.api_key):
                    raise Refused(401, "a key is needed")
                status, out = 200, make()
            except Refused as no:
                status, out = no.status, {"detail": str(no)}
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(lambda: service.get(self.path))

        def do_POST(self) -> None:
            self.answer(lambda: service.post(self.path, self.body()))

        def body(self) -> dict:
            if not self.headers.get("Content-Type", "").startswith("application/json"):
                raise Refused(415, "JSON is wanted")
            size = int(self.headers.get("Content-Length", 0))
            if size > MOST_BYTES:
                raise Refused(413, "too large")
            try:
                given = json.loads(self.rfile.read(size))
            except ValueError as error:
                raise Refused(422, "not JSON") from error
            if not isinstance(given, dict):
                raise Refused(422, "an object is wanted")
            return given

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
