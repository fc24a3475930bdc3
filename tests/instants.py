"""Instants written as text, for tests."""

from datetime import datetime


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
