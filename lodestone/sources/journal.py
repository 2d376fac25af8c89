"""An append-only journal of applied repairs, and their byte-exact reversal."""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path

VERSION, FOLDER = 1, ".lodestone"
TXN_ID = re.compile(r"txn-\d{4}-\d{2}-\d{2}-[0-9a-f]{6}")


class JournalError(Exception):
    """A journal that can't be written, found, replayed or reverted."""


@dataclass(frozen=True)
class CellFix:
    row: int
    column: str
    old_value: str
    new_value: str
    detector_id: str
    operation: str = "update"


@dataclass(frozen=True)
class Transaction:
    txn_id: str
    created_at: str
    source_path: str
    source_sha256: str
    snapshot_path: str
    fixes: tuple[CellFix, ...] = field(default=())
    applied: bool = False
    post_sha256: str | None = None
    reverted_at: str | None = None


def now() -> str:
    return datetime.now(UTC).isoformat()


def new_txn_id() -> str:
    return f"txn-{datetime.now(UTC):%Y-%m-%d}-{secrets.token_hex(3)}"


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _folder(source: str | Path, kind: str) -> Path:
    return Path(source).resolve().parent / FOLDER / kind


def _append(path: Path, event: dict, create: bool = False) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with open(path, "x" if create else "a", encoding="utf-8", newline="\n") as f:
            f.write(json.dumps({"schema_version": VERSION, "occurred_at": now()} | event, sort_keys=True) + "\n")
            f.flush()
            os.fsync(f.fileno())
    except OSError as e:
        raise JournalError(f"can't write {path}: {e}") from e


def log_path(source: str | Path, txn_id: str) -> Path:
    return _folder(source, "transactions") / f"{txn_id}.jsonl"


def begin(source: str | Path, fixes: list[CellFix]) -> Transaction:
    """Snapshot the source and record the transaction."""
    txn_id = new_txn_id()
    snapshot = _folder(source, "snapshots") / f"{txn_id}.bin"
    snapshot.parent.mkdir(parents=True, exist_ok=True)
    snapshot.write_bytes(Path(source).read_bytes())
    txn = Transaction(txn_id, now(), str(Path(source).resolve()), sha256_file(source), str(snapshot), tuple(fixes))
    _append(log_path(source, txn_id), {"event_type": "created", "transaction": asdict(txn)}, create=True)
    return txn


def mark_applied(txn: Transaction) -> Transaction:
    post = sha256_file(txn.source_path)
    _append(log_path(txn.source_path, txn.txn_id), {"event_type": "applied", "txn_id": txn.txn_id, "post_sha256": post})
    return replace(txn, applied=True, post_sha256=post)


def load(path: str | Path) -> Transaction:
    """Replay a journal: created, then applied, then reverted."""
    txn: Transaction | None = None
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except OSError as e:
        raise JournalError(f"can't read {path}: {e}") from e
    for line in filter(str.strip, lines):
        try:
            event = json.loads(line)
        except ValueError as e:
            raise JournalError(f"{path} holds a line that isn't JSON") from e
        kind = event.get("event_type")
        if event.get("schema_version") != VERSION:
            raise JournalError(f"unknown version in {path}")
        if kind == "created" and txn is None:
            found = event["transaction"]
            txn = Transaction(**found | {"fixes": tuple(CellFix(**x) for x in found["fixes"])})
        elif kind == "applied" and txn is not None:
            txn = replace(txn, applied=True, post_sha256=event["post_sha256"])
        elif kind == "reverted" and txn is not None:
            txn = replace(txn, reverted_at=event["occurred_at"])
        else:
            raise JournalError(f"unexpected event {kind!r} in {path}")
    if txn is None:
        raise JournalError(f"{path} records no transaction")
    return txn


def find(txn_id: str, root: str | Path = ".") -> Path:
    """The journal of a transaction below ``root``; none or several are errors."""
    if not TXN_ID.fullmatch(txn_id):
        raise JournalError(f"{txn_id!r} isn't a transaction id")
    direct = Path(root) / FOLDER / "transactions" / f"{txn_id}.jsonl"
    found = [direct] if direct.exists() else sorted(Path(root).rglob(f"{FOLDER}/transactions/{txn_id}.jsonl"))
    if len(found) != 1:
        raise JournalError(f"{len(found)} journals of {txn_id} below {root}")
    return found[0]


def apply(spark, source: str, fixes: list[CellFix]) -> Transaction:
    """Apply ordered cell fixes to a CSV file under the journal; on failure its bytes are restored.

    A fix whose row or column is missing, whose operation isn't an update, or whose old value is
    not what the cell holds refuses the whole batch.
    """
    from ..operators.apply import apply_fixes, stale_fixes
    from ..operators.policy import conflicting_writes
    from .tables import read_csv, write_csv

    table = read_csv(spark, source)
    wanted = spark.createDataFrame([(f.row, f.column, f.old_value, f.new_value, f.operation) for f in fixes], "_row bigint, column string, old_value string, new_value string, operation string")
    if wanted.where("operation <> 'update'").take(1):
        raise JournalError("only updates can be applied")
    if conflicting_writes(wanted).take(1):
        raise JournalError("two fixes write different values to one cell")
    if stale_fixes(table, wanted).take(1):
        raise JournalError("a fix is stale or its cell is missing")
    txn = begin(source, fixes)
    try:
        write_csv(apply_fixes(table, wanted.dropDuplicates(["_row", "column"])), source)
        return mark_applied(txn)
    except Exception:
        Path(source).write_bytes(Path(txn.snapshot_path).read_bytes())
        raise


def revert(txn_id: str, root: str | Path = ".") -> Transaction:
    """Restore the source's bytes, if nobody has changed it since."""
    path = find(txn_id, root)
    txn = load(path)
    if not txn.applied or txn.post_sha256 is None:
        raise JournalError(f"{txn_id} was never applied")
    if txn.reverted_at is not None:
        raise JournalError(f"{txn_id} was already reverted")
    for needed in (txn.source_path, txn.snapshot_path):
        if not Path(needed).exists():
            raise JournalError(f"{needed} is missing")
    if sha256_file(txn.source_path) != txn.post_sha256:
        raise JournalError("the file has changed since the repair")
    Path(txn.source_path).write_bytes(Path(txn.snapshot_path).read_bytes())
    if sha256_file(txn.source_path) != txn.source_sha256:
        raise JournalError("the restored bytes differ from the source's")
    _append(path, {"event_type": "reverted", "txn_id": txn_id})
    return load(path)
