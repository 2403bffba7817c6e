"""Protocol decoders as steps of :func:`~pulseframe.streaming.ordered.apply_ordered`: what the batch decoders give, row by row or over columns.

Each step keeps what is open (a frame, a word, an instant) in its key's state, which stays small however long the line is.
"""

from __future__ import annotations

import numpy as np

from ..functions.unsigned import signed
from ..schema import SEQ, TS
from .ordered import Columns, ColumnStep, Finish, Step


def uart_step(baud: float, data_bits: int = 8, parity: str = "none", stop_bits: float = 1, msb_first: bool = False, inverted: bool = False) -> tuple[Step, Finish]:
    """Line levels (``level``) to frames: ts_ns, seq, duration_ns, value, framing_error, parity_error; the last level holds to the end."""
    bit = 1e9 / baud
    checked = parity != "none"
    frame = 1 + data_bits + checked + stop_bits
    offsets = [int((1.5 + i) * bit + 0.5) for i in range(data_bits + checked)]
    if stop_bits:
        offsets.append(int((1 + data_bits + checked + min(stop_bits, 1) / 2) * bit + 0.5))
    resume, duration = int((frame - 0.25) * bit + 0.5), int(frame * bit + 0.5)

    def word(state: dict) -> list[dict]:
        start, seq, bits = state.pop("frame")
        value = sum(1 << (data_bits - 1 - i if msb_first else i) for i in range(data_bits) if bits[i])
        odd = value.bit_count() % 2 == 1
        expected = {"odd": not odd, "even": odd, "mark": True, "space": False}.get(parity)
        bad_stop = bool(stop_bits) and not bits[-1]
        return [{TS: start, SEQ: seq, "duration_ns": duration, "value": value, "framing_error": bad_stop, "parity_error": checked and bits[data_bits] != expected}]

    def read(state: dict, until: int | None) -> list[dict]:
        """Bits of the open frame whose middles come before ``until``, at the level that holds."""
        if "frame" not in state:
            return []
        start, _, bits = state["frame"]
        while len(bits) < len(offsets) and (until is None or start + offsets[len(bits)] < until):
            bits.append(state["level"])
        return word(state) if len(bits) == len(offsets) else []

    def step(state: dict, row: dict) -> list[dict]:
        new = bool(row["level"]) != inverted
        if state.get("level") == new:
            return []
        out = read(state, row[TS])
        state["level"] = new
        if not new and row[TS] >= state.get("resume", row[TS]):
            state["frame"], state["resume"] = (row[TS], row[SEQ], []), row[TS] + resume
        return out

    return step, lambda state: read(state, None)


def uart_columns(baud: float, data_bits: int = 8, parity: str = "none", stop_bits: float = 1, msb_first: bool = False, inverted: bool = False) -> ColumnStep:
    """As :func:`uart_step`, over columns: starts and bit middles of all frames are found by binary search among the level changes.

    The state is the changes from the open frame on, else the last one, and the time from which a frame may start.
    """
    bit = 1e9 / baud
    checked = parity != "none"
    frame = 1 + data_bits + checked + stop_bits
    offsets = [int((1.5 + i) * bit + 0.5) for i in range(data_bits + checked)]
    if stop_bits:
        offsets.append(int((1 + data_bits + checked + min(stop_bits, 1) / 2) * bit + 0.5))
    resume, duration, at = int((frame - 0.25) * bit + 0.5), int(frame * bit + 0.5), np.array(offsets, np.int64)
    place = [data_bits - 1 - i if msb_first else i for i in range(data_bits)]

    def read(state: dict, rows: Columns, ended: bool) -> Columns:
        own = (rows[TS], rows[SEQ], rows["level"].astype(bool) != inverted) if rows else ()
        ts, seq, high = (np.concatenate([x for x in pair if x is not None]) for pair in zip(state.pop("open", [None] * 3), own or [np.zeros(0, np.int64)] * 3, strict=True))
        if not len(ts):
            return {}
        moved = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        ts, seq, high = ts[moved], seq[moved], high[moved].astype(bool)
        falls = np.flatnonzero(~high & (ts >= state.get("resume", ts[0])))
        following, chosen, i = np.searchsorted(ts[falls], ts[falls] + resume).tolist(), [], 0
        while i < len(following):
            chosen.append(i)
            i = following[i]
        starts = falls[np.array(chosen, np.int64)]
        if not ended:
            done = int(np.count_nonzero(ts[starts] + at[-1] < ts[-1]))
            rest = int(starts[done]) if done < len(starts) else len(ts) - 1
            state["open"], starts = (ts[rest:], seq[rest:], high[rest:]), starts[:done]
            if done:
                state["resume"] = int(ts[starts[-1]]) + resume
        bits = high[np.searchsorted(ts, (ts[starts][:, None] + at).ravel(), "right") - 1].reshape(len(starts), len(at))
        value = bits[:, :data_bits] @ (1 << np.array(place, np.int64))
        no = np.zeros(len(starts), bool)
        odd = bits[:, :data_bits].sum(1) % 2 == 1
        expected = {"odd": ~odd, "even": odd, "mark": ~no, "space": no}.get(parity)
        return {
            TS: ts[starts], SEQ: seq[starts], "duration_ns": np.full(len(starts), duration), "value": value,
            "framing_error": ~bits[:, -1] if stop_bits else no, "parity_error": bits[:, data_bits] != expected if checked else no,
        }

    return ColumnStep(read)


def spi_step(lines: list[str], mode: int = 0, bits: int = 8, cs_active: str = "low", msb_first: bool = True) -> tuple[Step, Finish]:
    """Clock (side 0), chip select (side 1) and data lines (side 2 on), all as ``level``: line, ts_ns, seq, duration_ns, value, window_ns of each whole word.

    An edge counts once a later row shows that its window didn't end at that time.
    """
    rising = mode in (0, 3)

    def count(state: dict) -> list[dict]:
        at, values = state.pop("edge", (None, None))
        window = state.get("window")
        if at is None or window is None:
            return []
        k = window["n"] % bits
        if k == 0:
            window["first"], window["values"] = at, [0] * len(lines)
        for i, value in enumerate(values):
            window["values"][i] |= value << (bits - 1 - k if msb_first else k)
        window["n"] += 1
        if window["n"] % bits:
            return []
        word = {TS: window["first"], SEQ: window["n"] // bits - 1, "duration_ns": at - window["first"], "window_ns": window["start"]}
        return [word | {"line": name, "value": signed(window["values"][i])} for i, name in enumerate(lines)]

    def step(state: dict, row: dict) -> list[dict]:
        level, side = bool(row["level"]), row["side"]
        out = count(state) if "edge" in state and row[TS] > state["edge"][0] else []
        if side > 1:
            state[f"line{side - 2}"] = level
            return out
        before = state.get(side)
        state[side] = level
        if side == 1:
            if before != level and cs_active != "disabled":
                state["window"] = {"start": row[TS], "n": 0} if level == (cs_active == "high") else None
            return out
        window = state.setdefault("window", {"start": -1, "n": 0} if cs_active == "disabled" else None)
        if before is not None and before != level and level == rising and window is not None:
            state["edge"] = (row[TS], [int(state.get(f"line{i}", False)) for i in range(len(lines))])
        return out

    return step, count


def parallel_step(width: int, mode: str = "rising", cycles: int = 1, little_endian: bool = True, enable_high: bool | None = None, cs_active: str | None = None) -> Step:
    """Data lines (side below ``width``), enable (``width``), chip select (``width + 1``) and strobe (``width + 2``) as ``level`` to bus words.

    ``enable_high`` and ``cs_active`` are None where there is no such line. The strobe's modes are rising, falling and any.
    """
    active = {width: enable_high, width + 1: None if cs_active is None else cs_active == "high"}
    strobe = width + 2

    def step(state: dict, row: dict) -> list[dict]:
        level, side = bool(row["level"]), row["side"]
        before = state.get(side, False)
        known = side in state
        state[side] = level
        if side < width:
            return []
        if side < strobe:
            if level != active[side] and (level != before or not known):
                state["word"] = []
            return []
        if level == before or mode == "rising" and not level or mode == "falling" and level:
            return []
        if any(wanted is not None and state.get(i, False) != wanted for i, wanted in active.items()):
            state["word"] = []
            return []
        word = state.setdefault("word", [])
        word.append((row[TS], row[SEQ], sum(1 << i for i in range(width) if state.get(i, False))))
        if len(word) < cycles:
            return []
        state["word"] = []
        values = word if little_endian else word[::-1]
        value = sum(x[2] << (width * i) for i, x in enumerate(values))
        return [{TS: word[0][0], SEQ: min(x[1] for x in word), "duration_ns": word[-1][0] - word[0][0], "value": signed(value)}]

    return step


def i2c_step() -> tuple[Step, Finish]:
    """Clock (side 0) and data (side 1) as ``level`` to packets: ts_ns, end_ns, kind, value, acked. An instant is read once all its rows have come."""

    def instant(state: dict) -> list[dict]:
        if "now" not in state:
            return []
        at, clock, data = state.pop("now")
        was_clock, was_data = state.get("last", (True, True))
        state["last"] = (clock, data)
        mark = None
        if clock and was_clock:
            mark = "start" if was_data and not data else "stop" if data and not was_data else None
        active = state.get("state") == "start"
        if mark:
            state["state"], state["bits"], state["read"] = mark, [], None
            kind = "START REPEAT" if mark == "start" and active else "START" if mark == "start" else "STOP" if active else None
            return [{TS: at, "end_ns": at, "kind": kind, "value": None, "acked": None}] if kind else []
        if not active or not clock or was_clock:
            return []
        bits = state["bits"]
        bits.append((at, data))
        if len(bits) < 9:
            return []
        value = sum(1 << (7 - i) for i in range(8) if bits[i][1])
        first = state["read"] is None
        state["read"], state["bits"] = value % 2 == 1 if first else state["read"], []
        kind = ("ADDRESS " if first else "DATA ") + ("READ" if state["read"] else "WRITE")
        return [{TS: bits[0][0], "end_ns": at, "kind": kind, "value": value >> 1 if first else value, "acked": not bits[8][1]}]

    def step(state: dict, row: dict) -> list[dict]:
        out = instant(state) if "now" in state and state["now"][0] != row[TS] else []
        held = state["now"][1:] if "now" in state else state.get("levels", (True, True))
        levels = (bool(row["level"]), held[1]) if row["side"] == 0 else (held[0], bool(row["level"]))
        state["levels"], state["now"] = levels, (row[TS], *levels)
        return out

    return step, instant
