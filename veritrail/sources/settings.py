"""Small settings files, read on the driver."""

from __future__ import annotations

import os


def parse_dotenv(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines, with comments, ``export`` and quotes; variables that are set already win."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (part.strip() for part in line.split("=", 1))
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        elif " #" in value:
            value = value.split(" #", 1)[0].rstrip()
        out[key] = value
    return out | {k: v for k, v in (os.environ if environment is None else environment).items() if k in out}


def _scalar(text: str):
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _inline(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]") or text.startswith("{") and text.endswith("}"):
        parts, depth, quote, start = [], 0, "", 1
        for i, c in enumerate(text[1:-1], 1):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
            elif c == "," and not depth:
                parts.append(text[start:i])
                start = i + 1
        parts = [p for p in [*parts, text[start:-1]] if p.strip()]
        if text[0] == "[":
            return [_inline(p) for p in parts]
        return {k.strip().strip("\"'"): _inline(v) for k, v in (p.split(":", 1) for p in parts)}
    return _scalar(text)


def parse_yaml(text: str):
    """The subset that search spaces need: nested maps by indent, lists of dashes or in brackets, maps in braces, comments."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        pass
    lines = []
    for raw in text.splitlines():
        bare = raw.split(" #", 1)[0] if not raw.lstrip().startswith("#") else ""
        if bare.strip():
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, indent: int):
        items: list = []
        table: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            if body.startswith("- "):
                items.append(_inline(body[2:]))
                at += 1
                continue
            key, _, rest = body.partition(":")
            at += 1
            if rest.strip():
                table[key.strip().strip("\"'")] = _inline(rest)
            elif at < len(lines) and lines[at][0] > indent:
                table[key.strip().strip("\"'")], at = block(at, lines[at][0])
            else:
                table[key.strip().strip("\"'")] = None
        return (items or table), at

    return block(0, lines[0][0])[0] if lines else {}


def write_yaml(values: dict, header: str = "") -> str:
    """A flat map as YAML with a comment on top."""
    import json

    lines = [f"# {line}" for line in header.splitlines()]
    return "\n".join([*lines, *(f"{k}: {json.dumps(v)}" for k, v in values.items())]) + "\n"
