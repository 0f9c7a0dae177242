"""strftime patterns of FORMAT_DATE, PARSE_DATE and relatives as Java datetime patterns."""

from __future__ import annotations

from ..errors import Unsupported

_MAP = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "P": "a", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE",
    "j": "DDD", "Z": "VV", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "x": "MM/dd/yy", "X": "HH:mm:ss", "Q": "Q", "n": "\n", "t": "\t", "%": "%", "k": "H", "l": "h",
    "E4Y": "yyyy", "Ez": "xxx", "c": "EEE MMM d HH:mm:ss yyyy", "y2": "yy",
}


def java_pattern(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c != "%":
            j = i
            while j < len(fmt) and fmt[j] != "%":
                j += 1
            text = fmt[i:j]
            out.append("'" + text.replace("'", "''") + "'" if any(x.isalpha() for x in text) else text.replace("'", "''"))
            i = j
            continue
        spec = fmt[i + 1 : i + 2]
        if spec in ("E", "O") and fmt[i + 2 : i + 3]:
            rest = fmt[i + 2]
            if rest in "S*" or rest.isdigit() and fmt[i + 3 : i + 4] == "S":
                n = rest if rest.isdigit() else "6"
                out.append("ss" + ("." + "S" * int(n) if n != "0" else ""))
                i += 3 if rest == "S" else 4
                continue
            if rest == "4":
                out.append("yyyy")
                i += 4
                continue
            spec, i = ("Ez" if rest == "z" else rest), i + 1
        if spec not in _MAP:
            raise Unsupported(f"Unsupported format element %{spec}")
        out.append(_MAP[spec])
        i += 2
    return "".join(out)
