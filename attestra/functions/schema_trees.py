"""Schemas of JSON documents as trees, and the cheapest script of edits from one to the next.

Pure Python over one document or one short sequence of schemas; the operators in
``attestra.operators.drift`` call it from Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import lru_cache

#: Keys that say which configuration a record of a list belongs to.
LABELS = ("config", "configuration", "config_name", "model", "name", "label", "variant")

#: Cost of taking a node away or putting one in; moving one to another parent; a rename costs less the more speaks for it.
DELETE, ADD, MOVE = 1.0, 1.0, 0.5


def parsed(body: str | None) -> dict | None:
    """The JSON object of a body, ``NaN`` tokens allowed; None where it can't be read or is no object."""
    if body is None:
        return None
    try:
        value = json.loads(body.lstrip("\ufeff"), strict=False)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value: object) -> str | None:
    """string, boolean, integer, number, array, object; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    for kind, name in ((str, "string"), (int, "integer"), (float, "number"), (list, "array")):
        if isinstance(value, kind):
            return name
    return "object"


def _decoded(value: object) -> object:
    """A string that holds a JSON object or array as that object or array."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def records_of(value: object) -> list[tuple[str, dict]] | None:
    """Configuration records as (label, fields) if the value holds them in any form, else None.

    Forms: an object of objects, an array of objects with a labelling key, an object of equally
    long arrays one of which labels, and the text of any of these.
    """
    value = _decoded(value)
    if isinstance(value, dict) and value:
        inner = [v for v in value.values() if v is not None]
        if inner and all(isinstance(v, dict) for v in inner):
            return [(k, v or {}) for k, v in value.items()]
        if all(isinstance(v, list) for v in value.values()) and len({len(v) for v in value.values()}) == 1:
            return records_of([dict(zip(value, row)) for row in zip(*value.values())])
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        keys = [k for k in value[0] if all(isinstance(v.get(k), str) for v in value) and len({v[k] for v in value}) == len(value)]
        label = next((k for k in LABELS if k in keys), keys[0] if keys else None)
        return [(v[label] if label else str(i), {k: x for k, x in v.items() if k != label}) for i, v in enumerate(value)]
    return None


def container_of(document: dict) -> tuple[str | None, list[tuple[str, dict]]]:
    """The top-level key that holds the configuration records, and those records."""
    found = [(sum(len(fields) for _, fields in records), key, records) for key, value in document.items() if (records := records_of(value))]
    if not found:
        return None, []
    _, key, records = max(found, key=lambda f: f[0])
    return key, records


def _number(value: object) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        try:
            value = float(value.replace(",", "").strip().rstrip("%"))
        except ValueError:
            return None
    return float(value) if isinstance(value, (int, float)) and math.isfinite(value) else None


def _evidence(labelled: Iterable[tuple[str, object]]) -> dict:
    """What the values of a field look like: types, numbers by label, form of text, inner keys."""
    types, numbers, forms, keys = set(), {}, set(), set()
    for label, value in labelled:
        kind = type(value)
        if kind is float:
            types.add("number")
            if math.isfinite(value):
                numbers[label] = value
        elif kind is int:
            types.add("integer")
            numbers[label] = float(value) if abs(value) < 1 << 1000 else math.copysign(1e300, value)
        elif kind is str:
            types.add("string")
            if value[:1] in _NUMERIC and (n := _number(value)) is not None:
                numbers[label] = n
            else:
                forms.add(_form(value))
        elif value is not None:
            types.add(json_type(value))
            if kind is dict:
                keys |= set(value)
    return {"t": sorted(types), "n": numbers, "f": sorted(forms), "k": sorted(keys)}


#: What a text that is a number can begin with.
_NUMERIC = frozenset("0123456789+-.,iInN \t\r\n\v\f")


_ZONE, _DIGITS, _LETTERS = re.compile(r"(?:Z|[+-]\d\d:?\d\d)$"), re.compile(r"[0-9]+"), re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 14)
def _form(value: str) -> str:
    """The form of a text, letters and digits by kind; ``+`` before it says that it is a telling one. Long forms are digests."""
    form = _LETTERS.sub("a", _DIGITS.sub("9", _ZONE.sub("", value).lower()))
    mark = "+" if len(form) >= 8 and "9" in form else "-"
    return mark + (form if len(form) <= 32 else hashlib.md5(form.encode("utf-8", "replace")).hexdigest())


def shape_of(document: dict) -> dict[str, dict]:
    """Fields of a document by bare name: scope (0 top level, 1 in the records) and evidence."""
    container, records = container_of(document)
    shape: dict[str, dict] = {}
    for key, value in document.items():
        shape[key] = {"s": 0} | _evidence([("", value)])
        if key == container:
            shape[key]["k"], shape[key]["f"] = sorted({k for _, fields in records for k in fields}), []
            shape[key]["c"] = 1
    inner: dict[str, list[tuple[str, object]]] = {}
    for label, fields in records:
        for key, value in fields.items():
            inner.setdefault(key, []).append((label, value))
    for key, values in inner.items():
        if key not in shape:
            shape[key] = {"s": 1} | _evidence(values)
    return shape


def _tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if t]


def _abbreviates(short: str, tokens: list[str]) -> bool:
    """Is ``short`` a joining of non-empty beginnings of all the tokens, in order?"""
    if not tokens:
        return not short
    return any(short.startswith(tokens[0][:n]) and _abbreviates(short[n:], tokens[1:]) for n in range(1, min(len(short), len(tokens[0])) + 1))


def name_likeness(a: str, b: str) -> float:
    """0 to 1: how much two names look like names of the same quantity."""
    ta, tb = _tokens(a), _tokens(b)
    ja, jb = "".join(ta), "".join(tb)
    if ja == jb:
        return 1.0
    if len(tb) > 1 and len(ja) > 2 and _abbreviates(ja, tb) or len(ta) > 1 and len(jb) > 2 and _abbreviates(jb, ta):
        return 0.8
    common = max((len(x) if x == y else next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for x in ta for y in tb), default=0)
    if any(x == y and len(x) > 2 for x in ta for y in tb) or common >= 4:
        return 0.7
    ratio = SequenceMatcher(None, ja, jb).ratio()
    return 0.6 if ratio >= 0.75 else 0.3 * ratio


def value_likeness(a: dict, b: dict) -> float | None:
    """-1 to 1: do the values speak against or for one quantity? None where they say nothing."""
    if a["k"] and b["k"]:
        both = len(set(a["k"]) & set(b["k"])) / len(set(a["k"]) | set(b["k"]))
        return 1.0 if both >= 0.6 else -1.0
    if a["n"] and b["n"]:
        labels = a["n"].keys() & b["n"].keys()
        pairs = [(a["n"][k], b["n"][k]) for k in labels] or [(sorted(a["n"].values())[len(a["n"]) // 2], sorted(b["n"].values())[len(b["n"]) // 2])]
        if any(x <= 0 or y <= 0 for x, y in pairs):
            return 0.5 if all(x == y for x, y in pairs) else None
        gaps = sorted(abs(math.log(y / x)) for x, y in pairs)
        middle = gaps[len(gaps) // 2]
        return 1.0 if middle < 0.03 and len(labels) > 1 else 0.6 if middle < 0.35 else -1.0 if middle > 0.9 else 0.0
    if a["f"] and b["f"]:
        same = set(a["f"]) & set(b["f"])
        return (1.0 if any(f[0] == "+" for f in same) else 0.3) if same else None
    if not a["t"] or not b["t"]:
        return None
    return -0.5


def rename_cost(old: str, old_evidence: dict, new: str, new_evidence: dict) -> float:
    """Cost of a rename; at ``DELETE + ADD`` or more it is none."""
    names, values = name_likeness(old, new), value_likeness(old_evidence, new_evidence)
    if bool(old_evidence.get("c")) != bool(new_evidence.get("c")):
        return DELETE + ADD
    if names >= 0.5:
        return 2 - names - 0.5 * (values or 0) if values is None or values > -1 or names == 1 else DELETE + ADD
    return 1.5 - names - 0.5 * (values - 1) if values is not None and values >= 1 else DELETE + ADD


def assignment(costs: list[list[float]]) -> list[int]:
    """Column for each row (-1: none) at the least total cost; leaving a row out costs ``DELETE + ADD``.

    Shortest augmenting paths with potentials, cubic in the number of rows.
    """
    rows, wide = len(costs), (len(costs[0]) if costs else 0) + len(costs)
    full = [list(r) + [DELETE + ADD] * rows for r in costs]
    u, v, match = [0.0] * (rows + 1), [0.0] * (wide + 1), [0] * (wide + 1)
    for i in range(1, rows + 1):
        match[0], j0, least, way, used = i, 0, [math.inf] * (wide + 1), [0] * (wide + 1), [False] * (wide + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], math.inf, 0
            for j in range(1, wide + 1):
                if not used[j]:
                    c = full[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(wide + 1):
                if used[j]:
                    u[match[j]], v[j] = u[match[j]] + delta, v[j] - delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * rows
    for j in range(1, wide - rows + 1):
        if match[j] and costs[match[j] - 1][j - 1] < DELETE + ADD:
            out[match[j] - 1] = j - 1
    return out


def edit_script(before: dict[str, dict], after: dict[str, dict], apart=lambda a, b: True) -> tuple[float, list[tuple[str, str, str]]]:
    """Cheapest edits from one schema tree to the next: (cost, [(kind, old, new)]).

    Kinds are delete, add, rename, move (to another parent) and both at once (move with another name). Nodes with equal
    names are one; of the rest, old nodes are assigned to new ones at the least cost, whatever their parents:
    another parent costs ``MOVE`` more, and then the values must speak for it too. ``apart(a, b)`` says that two
    names are never seen together, without which one can't be the other's new name.
    """
    script = [("move", n, n) for n in before if n in after and before[n]["s"] != after[n]["s"]]
    cost = MOVE * len(script)

    def price(a: str, b: str) -> float:
        if not apart(a, b):
            return DELETE + ADD
        if before[a]["s"] == after[b]["s"]:
            return rename_cost(a, before[a], b, after[b])
        likeness = value_likeness(before[a], after[b])
        return rename_cost(a, before[a], b, after[b]) + MOVE if likeness is not None and likeness > 0 else DELETE + ADD

    old, new = [n for n in before if n not in after], [n for n in after if n not in before]
    costs = [[price(a, b) for b in new] for a in old]
    chosen = assignment(costs) if old and new else [-1] * len(old)
    for i, j in enumerate(chosen):
        if j < 0:
            script.append(("delete", old[i], ""))
            cost += DELETE
        else:
            script.append(("rename" if before[old[i]]["s"] == after[new[j]]["s"] else "move", old[i], new[j]))
            cost += costs[i][j]
    left = [n for j, n in enumerate(new) if j not in chosen]
    return cost + ADD * len(left), script + [("add", "", n) for n in left]


def _with_later_values(sequence: list[tuple[int, dict]], at: int, name: str) -> dict:
    """Evidence of a field from a file on, where its values are null there."""
    own = sequence[at][1][name]
    if own["t"]:
        return own
    return next((shape[name] | {"s": own["s"]} for _, shape in sequence[at + 1 :] if name in shape and shape[name]["t"]), own)


def history_of(sequence: list[tuple[int, dict]]) -> tuple[list[tuple[int, str, str, str, str, str]], dict[str, str]]:
    """Changes over a sequence of (file, shape), and for each name the first name of its quantity.

    Changes are (file, field, kind, other name, old type, new type). The tree that a file is compared
    with holds every quantity so far under its last name, so that one which is absent for a while
    is found again.
    """
    seen: dict[str, set[int]] = {}
    for i, (_, shape) in enumerate(sequence):
        for name in shape:
            seen.setdefault(name, set()).add(i)
    apart = lambda a, b: not seen[a] & seen[b]
    changes, canonical = [], {}
    tree: dict[str, dict] = {}
    state: dict[str, dict] = {}
    for i, (file, shape) in enumerate(sequence):
        here = {n: _with_later_values(sequence, i, n) for n in shape}
        if i:
            # Nothing is left to assign where every name is known, but names may have moved.
            _, script = edit_script(tree, here, apart) if any(tree.get(n, {}).get("s") != e["s"] for n, e in here.items()) else (0.0, [])
            for kind, old, new in script:
                if kind == "move":
                    changes.append((file, old, "moved", new if new != old else "", "", ""))
                if kind == "rename" or kind == "move" and old != new:
                    changes.append((file, old, "renamed", new, "", ""))
                    state[new] = state.pop(old)
                    tree.pop(old)
                    canonical.setdefault(new, canonical[old])
                elif kind == "add":
                    changes.append((file, new, "added", "", "", "+".join(here[new]["t"])))
        for name in shape:
            known = state.setdefault(name, {"last": i, "type": []})
            canonical.setdefault(name, name)
            now = shape[name]["t"]
            if now and known["type"] and now != known["type"]:
                changes.append((file, name, "retyped", "", "+".join(known["type"]), "+".join(now)))
            known["last"], known["type"] = i, now or known["type"]
            tree[name] = shape[name] if now or name not in tree else tree[name] | {"s": shape[name]["s"]}
    for name, known in state.items():
        if known["last"] + 1 < len(sequence):
            changes.append((sequence[known["last"] + 1][0], name, "removed", "", "+".join(known["type"]), ""))
    return changes, canonical
