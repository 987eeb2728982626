"""Fakes that tasks import by name: channels in a folder, a bot that logs."""

import json
import os
from pathlib import Path


def page(channel, after):
    """Two posts of a channel's file after an id."""
    path = Path(os.environ["NEWSLOOM_TEST"]) / f"{channel}.jsonl"
    rows = [json.loads(line) for line in path.read_text().splitlines()] if path.exists() else []
    return [(r["id"], r["body"], "2024-01-01T00:00:00Z") for r in rows if after is None or r["id"] > int(after)][:2]


def newest(channel):
    """The last id of a channel's file."""
    path = Path(os.environ["NEWSLOOM_TEST"]) / f"{channel}.jsonl"
    return str(max(json.loads(line)["id"] for line in path.read_text().splitlines())) if path.exists() else None


def bot(method, body):
    """Logs each call; fails as the folder's files say: `dies` after so many calls,
    chats in `rejects` always, those in `limits` once."""
    where, told = Path(os.environ["NEWSLOOM_TEST"]), json.loads(body)
    log = where / "calls"
    n = len(log.read_text().splitlines()) if log.exists() else 0
    dies = where / "dies"
    if dies.exists() and n >= int(dies.read_text()):
        os._exit(1)
    with log.open("a") as f:
        f.write(json.dumps({"method": method, **told}) + "\n")
    chat = told["chat_id"]
    if (where / "rejects").exists() and chat in (where / "rejects").read_text().split():
        return 400, json.dumps({"ok": False, "description": "Bad Request: no"})
    limits = where / "limits"
    if limits.exists() and chat in limits.read_text().split():
        limits.unlink()
        return 429, json.dumps({"ok": False, "description": "slow down", "parameters": {"retry_after": 0.01}})
    return 200, json.dumps({"ok": True, "result": {"message_id": 100 + n}})


def broken(method, body):
    raise OSError("no route")


def garbled(method, body):
    return 502, "<html>"
