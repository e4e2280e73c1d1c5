"""Bounded memories of what a worker has computed."""

from __future__ import annotations

from itertools import islice


def forget_half(known: dict, most: int) -> None:
    """Drop the older half of the entries, in place, once there are ``most``."""
    if len(known) >= most:
        for key in list(islice(known, most // 2)):
            del known[key]
