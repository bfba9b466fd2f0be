import sqlite3
import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from parlance.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """A new folder below the test's own temporary path."""
    def make(name: str = "d") -> str:
        path = tmp_path / f"{name}-{uuid.uuid4().hex[:8]}"
        path.mkdir()
        return str(path)
    return make


@pytest.fixture
def sqlite_file(folder):
    """Build a SQLite file from a script and rows per table."""
    def make(script: str, rows: dict[str, list[tuple]] | None = None) -> str:
        path = f"{folder('db')}/store.db"
        con = sqlite3.connect(path)
        con.executescript(script)
        for table, values in (rows or {}).items():
            con.executemany(f"INSERT INTO {table} VALUES ({','.join('?' * len(values[0]))})", values)
        con.commit()
        con.close()
        return path
    return make


def dicts(df, *order):
    """Rows as dictionaries, sorted by the given columns."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(repr(r[c]) if r[c] is None else r[c] for c in order)) if order else rows
