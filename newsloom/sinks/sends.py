"""Sends as a data sink: each post once, however often a batch is run.

format("channel_sends"), registered with spark.dataSource.register(ChannelSends), for
batches and streams of rows message, target, method, body.  Options:

- sender: module:function(method, body) that returns (HTTP status, response text) or
  raises on a transport error;
- ledger: a folder that all tasks share, or module:function that returns a store with
  get(key) and put(key, row);
- pause_ms: the wait after a send (3000).

The ledger holds one row for each message and target: the digest of what was sent, the
post's number and time, or the error.  It is written after every single send, so a
batch that is run again skips what is current and sends only what is missing or has
changed; a text that changed after it was posted is an edit of the same post.  A
send that the service limits is tried once more after the time it asks for (429: a
minute); a rejected one is recorded and the rest go on.  Rejected rows of a batch are
sent again when they come again: resend() names them.

Sends are limited to some per minute and chat, so a ledger of one small file for each
message and target holds all there ever is to look up: the task that sends asks for
its own rows and never reads the whole.  Partition by target to keep a chat in one
task."""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

LEDGER = "message string, target string, method string, digest string, ok boolean, tgId string, error string, at long, tries long"
ATTEMPTS = 2
PAUSE_MS = 3000
LIMITED_MS = 60_000


class Folder:
    """One JSON file for each key, in any store that pyarrow opens; a write is whole or
    not there."""

    def __init__(self, path: str):
        self.store, self.path = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def _file(self, key: str) -> tuple[str, str]:
        name = hashlib.sha1(key.encode()).hexdigest()
        return f"{self.path}/p={name[:2]}", f"{name}.json"

    def get(self, key: str) -> dict | None:
        try:
            with self.store.open_input_file("/".join(self._file(key))) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, row: dict) -> None:
        folder, name = self._file(key)
        self.store.create_dir(folder)
        part = f"{folder}/_{uuid.uuid4().hex}"  # Spark skips such names
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps(row, ensure_ascii=False).encode())
        self.store.move(part, f"{folder}/{name}")


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def dry_run(method: str, body: str) -> tuple[int, str]:
    """A sender that sends nothing: every post is taken, its number is its length."""
    return 200, json.dumps({"ok": True, "result": {"message_id": len(body)}})


@dataclass
class Sent(WriterCommitMessage):
    sent: int
    skipped: int
    rejected: int


class _Writer:
    """Sends the rows of one partition."""

    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows: Iterator) -> Sent:
        where = self.options["ledger"]
        ledger = Folder(where) if "/" in where else _named(where)()
        send, pause = _named(self.options["sender"]), float(self.options.get("pause_ms", PAUSE_MS))
        count = {"sent": 0, "skipped": 0, "rejected": 0}
        for row in rows:
            key = f"{row['message']}\n{row['target']}"
            digest = hashlib.sha256(f"{row['method']}\n{row['body']}".encode()).hexdigest()
            known = ledger.get(key) or {}
            if known.get("ok") and known["digest"] == digest:
                count["skipped"] += 1
                continue
            found = self._send(send, row, known, pause)
            tries = 1 + (known.get("tries", 0) if not known.get("ok") else 0)
            ledger.put(key, {"message": row["message"], "target": row["target"], "digest": digest, **found, "at": int(time.time() * 1000), "tries": tries})
            count["sent" if found["ok"] else "rejected"] += 1
        return Sent(**count)

    def _send(self, send, row, known: dict, pause: float) -> dict:
        """Method, ok, tgId and error of one send; a known post is edited."""
        method, body = row["method"], row["body"]
        if known.get("tgId") and method != "editMessageText":
            told = json.loads(body)
            method, body = "editMessageText", json.dumps({"chat_id": told.get("chat_id"), "message_id": int(known["tgId"]) if known["tgId"].isdigit() else known["tgId"], "text": told.get("text", told.get("caption"))}, ensure_ascii=False)
        error = "no attempt was made"
        for _ in range(ATTEMPTS):
            wait = None
            try:
                status, text = send(method, body)
            except Exception as failure:  # the transport failed: what the service did is unknown, and it is asked again next time
                time.sleep(pause / 1000)
                return {"method": method, "ok": False, "tgId": known.get("tgId"), "error": str(failure)}
            try:
                told = json.loads(text)
            except ValueError:
                told = None
            if not isinstance(told, dict) or not isinstance(told.get("ok"), bool):
                time.sleep(pause / 1000)
                return {"method": method, "ok": False, "tgId": known.get("tgId"), "error": f"not an answer (HTTP {status})"}
            after = (told.get("parameters") or {}).get("retry_after")
            if not told["ok"]:
                wait = after * 1000 if after is not None else LIMITED_MS if status == 429 else None
            time.sleep(max(wait or 0, pause) / 1000)
            if told["ok"]:
                number = (told.get("result") or {}).get("message_id", "") if isinstance(told.get("result"), dict) else ""
                return {"method": method, "ok": True, "tgId": known.get("tgId") or str(number), "error": None}
            error = told.get("description") or "no description"
            if wait is None:
                break
        return {"method": method, "ok": False, "tgId": known.get("tgId"), "error": error}


class _BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages) -> None:
        """The ledger has everything."""

    def abort(self, messages) -> None:
        """What was sent stays sent, and the ledger says so."""


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:
        """The ledger has everything."""

    def abort(self, messages, batchId) -> None:
        """What was sent stays sent, and the ledger says so."""


class ChannelSends(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channel_sends"

    def schema(self) -> str:
        return "message string, target string, method string, body string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


def results(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger as publish.published_state takes it: message, target, method, ok,
    tgId, error, at (and tries)."""
    return spark.read.schema(LEDGER).json(ledger).select("message", "target", "method", "ok", "tgId", "error", "at", "tries")


def resend(requests: DataFrame, ledger: DataFrame, now_ms: int, delay_ms: int = LIMITED_MS, most: int = 5) -> DataFrame:
    """The requests whose last send was rejected and whose turn has come: delay_ms
    doubles with every try, up to `most` tries."""
    bad = ledger.where(~F.col("ok") & (F.col("tries") < most))
    due = bad.where(F.col("at") + F.lit(delay_ms) * F.pow(F.lit(2.0), F.col("tries") - 1) <= now_ms)
    return requests.join(due.select("message", "target"), ["message", "target"], "left_semi")
