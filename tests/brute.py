"""Plain sequential resolution, the yardstick of the parallel one (own wording of the rule)."""

import re

from millrace.functions.names import LEGAL_FORM_WORDS

_FORMS = re.compile(r"\b(" + "|".join(LEGAL_FORM_WORDS) + r")\b")


def normalize(name):
    text = re.sub(r"[^\w\s]", " ", name.lower().strip())
    return " ".join(_FORMS.sub(" ", text).split())


def ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    if not total:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return (1.0 - (total - 2 * row[-1]) / total) * 100.0


def decide(raw, known, threshold):
    """Outcome of one name, given the entries (exact key, normalized key, canonical) known before it."""
    if not (raw or "").strip():
        return raw, "skipped_empty", 0.0
    key, norm = raw.lower().strip(), normalize(raw)
    for column, wanted, method, confidence in ((0, key, "exact", 1.0), (1, norm, "normalized", 0.97)):
        hits = [entry[2] for entry in known if entry[column] == wanted]
        if hits:
            return hits[-1], method, confidence
    # An entry's place is where its normalized key came first, its name the one written last.
    places = {n: -i for i, (_, n, _) in reversed(list(enumerate(known)))}
    owners = {n: owner for _, n, owner in known}
    score, _, owner = max(((ratio(norm, n), place, owners[n]) for n, place in places.items()), default=(0.0, 0, None))
    return (owner, "fuzzy", score / 100.0) if score >= threshold else (raw.strip(), "new_entity", 1.0)


def sequential(names, seeds, threshold):
    known = [(alias.lower().strip(), normalize(alias), canonical) for canonical, alias in seeds]
    out = []
    for raw in names:
        out.append(decide(raw, known, threshold))
        known += [(raw.lower().strip(), normalize(raw), out[-1][0])] if out[-1][1] == "new_entity" else []
    return out
