"""Labelled findings made by rule: values of documented shapes, and look-alikes that are no secrets, inside sentences.

They are the same on every run.  A scan trains on them besides the findings of its own table, so that the network
knows shapes that the table lacks, and what only looks like a value.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

COUNT = 3000  # of either class
HEX, DIGITS, ALNUM = "0123456789abcdef", string.digits, string.ascii_letters + string.digits
BASE64 = ALNUM + "+/"
WORDS = (
    "the report was sent to our office and a copy of it lies in the archive where people can read all pages about "
    "weather music travel garden history der die und nicht auf eine les des une dans pour los una con para server mail"
).split()
# What stands before a value: some name it, most say nothing.
LEADS = ("", "", "", "key ", "key=", "pwd=", "pass: ", "passphrase: ", "auth ", "Bearer ", "id=", "value: ", '"', "'", "(", "> ")


def _pick(rng: random.Random, letters: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choices(letters, k=rng.randint(least, most or least)))


def _mixed(rng: random.Random, letters: str, least: int, most: int) -> str:
    """A value with letters and digits among each other, as generators of passwords give them."""
    while True:
        value = _pick(rng, letters, least, most)
        if sum(c.isdigit() for c in value) >= 2 and sum(c.isalpha() for c in value) >= 3:
            return value


SECRETS = (
    lambda r: _mixed(r, HEX, 24, 64),
    lambda r: _mixed(r, ALNUM, 16, 44),
    lambda r: _mixed(r, BASE64, 40, 40),
    lambda r: _mixed(r, string.ascii_lowercase + DIGITS, 14, 32),
    lambda r: r.choice(("ghp_", "gho_", "glpat-")) + _mixed(r, ALNUM, 20, 36),
    lambda r: r.choice(("sk_live_", "pk_live_", "sk-")) + _mixed(r, ALNUM, 24, 40),
    lambda r: f"xoxb-{_pick(r, DIGITS, 10, 12)}-{_pick(r, DIGITS, 10, 12)}-{_mixed(r, ALNUM, 24, 24)}",
    lambda r: ".".join(("eyJ" + _mixed(r, ALNUM, 20, 33), "eyJ" + _mixed(r, ALNUM, 30, 60), _mixed(r, ALNUM + "_-", 43, 43))),
    lambda r: "AIza" + _mixed(r, ALNUM + "_-", 35, 35),
    lambda r: f"SG.{_mixed(r, ALNUM, 22, 22)}.{_mixed(r, ALNUM, 43, 43)}",
)
OTHERS = (
    lambda r: _pick(r, DIGITS, 8, 20),
    lambda r: _pick(r, DIGITS, 16),
    lambda r: "-".join(_pick(r, DIGITS, 4) for _ in range(4)),
    lambda r: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(("", "T10", f"T{r.randint(10, 23)}-30-00")),
    lambda r: f"+{_pick(r, DIGITS, 2)}-{_pick(r, DIGITS, 3)}-{_pick(r, DIGITS, 6, 8)}",
    lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    lambda r: f"v{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}-beta.{r.randint(1, 9)}",
    lambda r: "/".join(r.choices(WORDS, k=r.randint(2, 6))) + r.choice(("", ".html", f"/{r.randint(1, 99999)}", f"/page{r.randint(1, 99)}")),
    lambda r: "/" + "-".join(r.choices(WORDS, k=r.randint(3, 8))) + "/" + _pick(r, DIGITS, 4, 10),
    lambda r: "-".join(r.choices(WORDS, k=r.randint(2, 5))),
    lambda r: "_".join(r.choices(WORDS, k=r.randint(2, 5))) + r.choice(("", str(r.randint(1, 99)))),
    lambda r: "".join(w.title() for w in r.choices(WORDS, k=r.randint(2, 4))) + r.choice(("", str(r.randint(1, 2030)))),
    lambda r: f"{r.choice(WORDS)}.{r.choice(WORDS)}{r.randint(1, 9999)}.{r.choice(('example.com', 'org', 'net'))}",
    lambda r: r.choice("-=_.+") * r.randint(8, 60),
    lambda r: "".join(r.choices(string.ascii_lowercase, k=r.randint(8, 16))),
    lambda r: r.choice(WORDS).title() + r.choice(WORDS) * r.randint(1, 3),
    lambda r: "".join(r.choices(WORDS, k=r.randint(2, 5))).upper(),
    lambda r: "".join(r.choices(string.ascii_uppercase, k=r.randint(8, 16))),
    lambda r: f"{r.choice(WORDS)}={r.choice(WORDS)}{r.randint(0, 999)}",
)


def examples(count: int = COUNT, seed: int = 17) -> Iterator[tuple[str, int, int, bool]]:
    """Text, start and end of its value, and whether that is a secret; `count` of either class."""
    rng = random.Random(seed)
    for secret, kinds in ((True, SECRETS), (False, OTHERS)):
        for i in range(count):
            value = kinds[i % len(kinds)](rng)
            before = " ".join(rng.choices(WORDS, k=rng.randint(0, 8))) + rng.choice((" ", " ", "\n", ": "))
            lead = rng.choice(LEADS)
            behind = rng.choice(("", " ", ". ", "\n", '"', "' ", ", ")) + " ".join(rng.choices(WORDS, k=rng.randint(0, 5)))
            start = len(before) + len(lead)
            yield before + lead + value + behind, start, start + len(value), secret
