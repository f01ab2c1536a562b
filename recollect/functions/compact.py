"""A compact text form of JSON for prompts: indentation for objects, tables for uniform rows."""

from __future__ import annotations

import json
import re

_NUMERIC = re.compile(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_SPECIAL = re.compile(r'[:"\\,\[\]{}\x00-\x1f\x7f-\x9f]')
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(s: str) -> str:
    plain = s and s == s.strip() and s[0] != "-" and s not in ("true", "false", "null") and not _NUMERIC.fullmatch(s) and not _SPECIAL.search(s)
    if plain:
        return s
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in s) + '"'


def _flat(v: object) -> bool:
    return not isinstance(v, (dict, list)) or not v


def _scalar(v: object) -> str:
    return quoted(v) if isinstance(v, str) else json.dumps(v)


def _columns(rows: list) -> list[str] | None:
    first = rows[0]
    if not isinstance(first, dict) or not first:
        return None
    same = all(isinstance(r, dict) and r.keys() == first.keys() and all(map(_flat, r.values())) for r in rows)
    return sorted(first) if same else None


def _array(rows: list, depth: int) -> list[str]:
    """The lines of an array; the first continues its key."""
    if all(map(_flat, rows)):
        return [f"[{len(rows)}]: " + ",".join(map(_scalar, rows))]
    if cols := _columns(rows):
        head = f"[{len(rows)}]{{{','.join(map(quoted, cols))}}}:"
        return [head, *("  " * (depth + 1) + ",".join(_scalar(r[c]) for c in cols) for r in rows)]
    out, pad = [f"[{len(rows)}]:"], "  " * (depth + 1)
    for v in rows:
        if isinstance(v, dict) and v:
            out += [pad + "-", *_object(v, depth + 2)]
        elif isinstance(v, list) and v:
            first, *rest = _array(v, depth + 1)
            out += [pad + "-" + first, *rest]
        else:
            out.append(pad + "- " + _scalar(v))
    return out


def _object(o: dict, depth: int) -> list[str]:
    out, pad = [], "  " * depth
    for k in sorted(o):
        v = o[k]
        if isinstance(v, dict) and v:
            out += [f"{pad}{quoted(k)}:", *_object(v, depth + 1)]
        elif isinstance(v, list) and v:
            first, *rest = _array(v, depth)
            out += [f"{pad}{quoted(k)}{first}", *rest]
        else:
            out.append(f"{pad}{quoted(k)}: {_scalar(v)}")
    return out


def encode(value: object) -> str:
    if isinstance(value, dict) and value:
        lines = _object(value, 0)
    elif isinstance(value, list) and value:
        lines = _array(value, 0)
    else:
        lines = [_scalar(value)]
    return "\n".join(lines) + "\n"


def render(rows: list[dict], accepts_compact: bool) -> dict:
    """The rows as compact text if the client takes it, else as JSON with what it would have saved."""
    slim = [{"id": r["id"], "text": r["text"], "score": round(r["score"], 4)} for r in rows]
    plain, short = json.dumps(slim, ensure_ascii=False), encode(slim)
    if accepts_compact:
        return {"format": "compact", "body": short}
    return {"format": "json", "body": plain, "saved_percent": max(0, round(100 * (len(plain) - len(short)) / max(1, len(plain))))}
