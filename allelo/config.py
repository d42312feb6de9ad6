"""Options of a run as a text of ``key=value`` lines, read and written."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Options:
    """The options this engine uses; others are kept as text in ``other`` and written back."""

    datatype: str = "sequence"
    infile: str = "infile"
    title: str = ""
    random_seed: int | None = None
    long_sample: int = 5000
    long_inc: int = 100
    burn_in: int = 10000
    replicate: int = 1
    heating: list[float] = field(default_factory=lambda: [1.0, 1.5, 3.0, 1000000.0])
    population_relabel: list[int] = field(default_factory=list)
    random_subset: int | None = None
    nodata: bool = False
    smooth: bool = True
    custom_migration: str = ""
    bayes_priors: list[str] = field(default_factory=list)
    other: dict[str, str] = field(default_factory=dict)


_KEYS = {f.name.replace("_", "-"): f for f in fields(Options) if f.name not in ("other", "bayes_priors")}


def _parse(kind: str, text: str):
    text = text.strip()
    if kind.startswith("list"):
        inner = text.split(":", 1)[-1] if ":" in text else text
        parts = [x for x in re.split(r"[,{}\s]+", inner) if x]
        return [(float if "float" in kind else int)(x) for x in parts if re.fullmatch(r"[-+0-9.eE]+", x)]
    if kind == "bool":
        return text.upper().startswith("Y") or text.lower() == "true"
    if "int" in kind:
        m = re.search(r"-?\d+", text)
        return int(m[0]) if m else None
    return text


def parse(text: str) -> Options:
    """Lines ``key=value``; ``#`` begins a comment, ``end`` ends the options, unknown keys are kept."""
    o = Options()
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.lower() == "end":
            break
        if "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        name = key.lower()
        if name == "bayes-priors":
            o.bayes_priors.append(value)
        elif name in _KEYS:
            setattr(o, _KEYS[name].name, _parse(str(_KEYS[name].type), value))
        else:
            o.other[key] = value
    return o


def read(path: str) -> Options:
    return parse(Path(path).read_text(errors="replace"))


def write(o: Options) -> str:
    def text(v) -> str:
        return ("YES" if v else "NO") if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, list) else str(v)

    lines = [f"{k}={text(v)}" for k, f in _KEYS.items() if (v := getattr(o, f.name)) not in (None, [])]
    lines += [f"bayes-priors={p}" for p in o.bayes_priors] + [f"{k}={v}" for k, v in o.other.items()]
    return "\n".join([*lines, "end", ""])
