"""Frames: of video and microscope files (with readers that may not be installed), of a camera, and out to a browser.

What needs a library that is missing fails when it is used, not when this module is imported.
"""

from __future__ import annotations

import http.server
import importlib
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.operators.images import raster_type

BOUNDARY = "frame"


class UnavailableObjectError(ImportError):
    """What was asked for needs a library that isn't installed."""


class UnavailableObject:
    """Stands for such an object: using it in any way raises."""

    def __init__(self, name: str, error: Exception):
        object.__setattr__(self, "_why", (name, error))

    def _fail(self, *_: Any, **__: Any):
        name, error = object.__getattribute__(self, "_why")
        raise UnavailableObjectError(f"{name} is not available: {error}") from error

    __call__ = _fail

    def __getattr__(self, name: str):
        self._fail()


def optional(module: str, name: str | None = None) -> Any:
    """A module or an object of it, or an ``UnavailableObject``."""
    try:
        found = importlib.import_module(module)
        return getattr(found, name) if name else found
    except (ImportError, AttributeError) as e:
        return UnavailableObject(f"{module}.{name}" if name else module, e)


def check_available(*objects: Any) -> None:
    """Raises if one of them is unavailable."""
    for x in objects:
        if isinstance(x, UnavailableObject):
            x._fail()


def read_frames(spark: SparkSession, paths: list[str], open_file: Callable[[str], Iterator[tuple[int, int, np.ndarray, dict]]] | None = None, series: list[int] | None = None) -> DataFrame:
    """path, series, frame_no, image and metadata of each frame; a file is one task's work, and frames are streamed from it.

    ``open_file`` gives (series, frame number, array, metadata) of a path; by default the ``pims`` library does. ``series`` picks some, else all.
    """
    if open_file is None:
        check_available(pims := optional("pims"))

        def open_file(path: str):
            video = pims.open(path)
            for n, frame in enumerate(video):
                yield 0, n, np.asarray(frame), dict(getattr(frame, "metadata", {}) or {})

    def run(pdfs):
        for pdf in pdfs:
            for path in pdf["path"]:
                for s, n, a, meta in open_file(path):
                    if series is None or s in series:
                        image = {"height": a.shape[0], "width": a.shape[1], "channels": 1 if a.ndim == 2 else a.shape[2], "data": a.reshape(-1).astype(float)}
                        yield pd.DataFrame({"path": [path], "series": [s], "frame_no": [n], "image": [image], "metadata": [{str(k): str(v) for k, v in meta.items()}]})

    src = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return src.mapInPandas(run, f"path string, series int, frame_no long, image {raster_type().simpleString()}, metadata map<string,string>")


def is_raspberrypi() -> bool:
    """Whether this machine says so of itself."""
    try:
        with open("/sys/firmware/devicetree/base/model", "rb") as f:
            return b"raspberry pi" in f.read().lower()
    except OSError:
        return False


def camera_stream(spark: SparkSession, capture: Callable[[int], np.ndarray], fps: int = 1) -> DataFrame:
    """An endless stream of frame_no, timestamp and image, ``capture`` being called for each tick of a rate source. Each frame is an object of its own."""
    @F.pandas_udf(raster_type())
    def take(n: pd.Series) -> pd.DataFrame:
        made = [np.asarray(capture(int(i)), float) for i in n]
        return pd.DataFrame({"height": [a.shape[0] for a in made], "width": [a.shape[1] for a in made], "channels": [1 if a.ndim == 2 else a.shape[2] for a in made], "data": [a.reshape(-1) for a in made]})

    ticks = spark.readStream.format("rate").option("rowsPerSecond", fps).option("numPartitions", 1).load()
    return ticks.select(F.col("value").alias("frame_no"), "timestamp", take("value").alias("image"))


def pi_camera(spark: SparkSession, fps: int = 1, **settings: Any) -> DataFrame:
    """Frames of this board's camera; the driver must run on it."""
    check_available(library := optional("picamera2", "Picamera2"))
    camera = library()
    camera.configure(camera.create_still_configuration(**settings))
    camera.start()
    return camera_stream(spark, lambda _: camera.capture_array(), fps)


def pack_message(name: str, data: bytes) -> bytes:
    """``name``, a line break, and the frame."""
    if "\n" in name:
        raise ValueError("a name has no line break")
    return name.encode() + b"\n" + data


def unpack_message(message: bytes) -> tuple[str, bytes]:
    name, _, data = message.partition(b"\n")
    return name.decode(), data


class Publisher:
    """The latest frame of each name, for any number of readers; a slow reader misses frames, it never holds up the others."""

    def __init__(self) -> None:
        self.latest: dict[str, tuple[int, bytes]] = {}
        self.changed = threading.Condition()

    def publish(self, message: bytes) -> None:
        name, data = unpack_message(message)
        with self.changed:
            self.latest[name] = (self.latest.get(name, (0, b""))[0] + 1, data)
            self.changed.notify_all()

    def subscribe(self, name: str, max_fps: float | None = None, timeout: float = 10.0) -> Iterator[bytes]:
        seen = 0
        while True:
            with self.changed:
                if not self.changed.wait_for(lambda: self.latest.get(name, (0, b""))[0] > seen, timeout):
                    return
                seen, data = self.latest[name]
            yield data
            if max_fps:
                time.sleep(1 / max_fps)


class FrameServer:
    """Serves the frames of a publisher over HTTP as a multipart stream, at ``/<name>``."""

    def __init__(self, publisher: Publisher, address: tuple[str, int] = ("127.0.0.1", 0), max_fps: float | None = None, kind: str = "image/png"):
        class Handler(http.server.BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_GET(self):
                name = self.path.strip("/")
                if name not in publisher.latest:
                    self.send_error(404)
                    return
                self.send_response(200)
                self.send_header("Content-Type", f"multipart/x-mixed-replace; boundary={BOUNDARY}")
                self.end_headers()
                try:
                    for data in publisher.subscribe(name, max_fps):
                        self.wfile.write(f"--{BOUNDARY}\r\nContent-Type: {kind}\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n")
                except OSError:
                    pass

        self.server = http.server.ThreadingHTTPServer(address, Handler)
        self.server.daemon_threads = True
        self.address = self.server.server_address

    def __enter__(self):
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def stream_frames(frames: DataFrame, publisher: Publisher, image: str = "image", name: str = "frames", order: str = "frame_no", max_fps: float | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that publishes each micro-batch's frames, those above ``max_fps`` left out. Only what is shown comes to the driver: at most
    ``max_fps`` frames for each second since the last batch (one, without that limit)."""
    from seston.operators.images import encode_png

    state = {"last": 0.0}

    def publish(batch: DataFrame, _: int) -> None:
        now = time.time()
        room = max(1, int((now - state["last"]) * max_fps)) if max_fps and state["last"] else 1
        state["last"] = now
        shown = batch.orderBy(F.col(order).desc()).limit(min(room, 16)).select(order, encode_png(F.col(image)).alias("png"))
        for r in sorted(shown.collect(), key=lambda r: r[order]):
            publisher.publish(pack_message(name, bytes(r["png"])))

    return publish
