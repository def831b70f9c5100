"""The interactive session: put, get, delete, scan, prefix, begin, commit, abort, flush, compact, stats, help, quit."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from .model import Mutation
from .sources.store import Database

HELP = """put KEY VALUE...      store the rest of the line
get KEY               show a value
delete KEY            delete a key
scan FROM TO [LIMIT]  keys from FROM up to TO, without it
prefix P [LIMIT]      keys that start with P
begin, commit, abort  collect puts and deletes into one atomic batch
flush, compact, stats, help, quit"""
#: Fixed value: rows of a scan without a limit.
DEFAULT_LIMIT = 20


class Session:
    def __init__(self, db: Database, out: TextIO) -> None:
        self.db, self.out = db, out
        self.batch: list[Mutation] | None = None

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, lines: Iterable[str]) -> int:
        for line in lines:
            words = line.split(maxsplit=1)
            if not words:
                continue
            if words[0] in ("quit", "exit"):
                break
            try:
                self.command(words[0], words[1].rstrip("\n") if len(words) > 1 else "")
            except (ValueError, OSError, RuntimeError) as e:
                self.say(f"error: {e}")
        if self.batch is not None:
            self.say("the open batch is discarded")
        return 0

    def command(self, name: str, rest: str) -> None:
        words = rest.split()
        if name == "put":
            key, _, value = rest.partition(" ")
            self._write(Mutation(key, value.lstrip()))
        elif name == "get":
            value = self.db.get(words[0] if words else "")
            self.say("(not found)" if value is None else value)
        elif name == "delete":
            self._write(Mutation(words[0] if words else "", None))
        elif name == "scan":
            start, end, limit = (*words, *[""] * 3)[:3] if len(words) != 2 or not words[1].isdigit() else (words[0], words[1], "")
            self._rows(self.db.scan(start, end, _limit(limit)))
        elif name == "prefix":
            prefix, limit = (*words, "", "")[:2]
            self._rows(self.db.scan_prefix(prefix, _limit(limit)))
        elif name == "begin":
            if self.batch is not None:
                raise ValueError("a batch is open already")
            self.batch = []
            self.say("batch open")
        elif name in ("commit", "abort"):
            if self.batch is None:
                raise ValueError("no batch is open")
            if name == "commit":
                self.db.write_batch(self.batch)  # the batch stays open if this fails
                self.say(f"committed {len(self.batch)}")
            else:
                self.say("batch discarded")
            self.batch = None
        elif name in ("flush", "compact"):
            getattr(self.db, name)()
            self.say("ok")
        elif name == "stats":
            for k, v in vars(self.db.stats()).items():
                self.say(f"{k}={v}")
        elif name == "help":
            self.say(HELP)
        else:
            self.say("unknown command; type 'help'")

    def _write(self, m: Mutation) -> None:
        if self.batch is None:
            self.db.write_batch([m])
            self.say("ok")
        else:
            self.batch.append(m)
            self.say("queued")

    def _rows(self, rows: list[tuple]) -> None:
        for k, v in rows:
            self.say(f"{k} = {v}")


def _limit(word: str) -> int:
    if not word:
        return DEFAULT_LIMIT
    if not word.isdigit():
        raise ValueError(f"{word!r} is no limit")
    return int(word)


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m tidemark PATH", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        db = Database(spark, args[0])
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return Session(db, sys.stdout).run(sys.stdin)
