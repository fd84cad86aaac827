"""Labelled examples of personal data and of look-alikes, made by rule.

An example is a value in a context: personal values mostly after a word that announces them, look-
alikes after words that announce something else, in rows of numbers, before units, or with made-up
digits.  What stands before and behind is drawn from the same plain words for both.  Most look-alikes
pass the strict check of their format: what tells them apart is context and shape.
"""

from __future__ import annotations

import random
from collections.abc import Callable

#: Examples per generator: one half personal, one half not; a fifth is held out for calibration.
EXAMPLES = 1000
SEED = 5003

PLAIN = ("and then ", "it was ", "of the other ", "\n", "(", "is ", "see ", "there, ", "said ")
AFTER = ("", ".", ", and", " or later", ")", "\n", "; then", " before noon")
CUES = {
    "phone_local": ("call me at ", "tel. ", "Phone: ", "fax ", "my mobile ", "call ", "telephone ", "tel: "),
    "ssn": ("SSN ", "social security number ", "ssn: ", "Social Security no. ", "social security "),
    "iban": ("IBAN ", "iban: ", "bank account ", "my account: ", "pay to IBAN: "),
    "email_words": ("mail ", "contact ", "e-mail: ", "email me: ", "Contact: ", "mail to "),
    "ip6": ("from host ", "server ", "address ", "ip ", "host: ", "ip address: "),
    "card_wide": ("card ", "visa ", "pay by card ", "card number: ", "mastercard ", "my card "),
}
OTHERS = ("order ", "part no. ", "item ", "invoice ", "serial ", "isbn ", "version ", "ref. ", "model ", "lot ", "batch ", "ticket ", "code ", "checksum ", "fingerprint ", "build ")
UNITS = (" units", " kg", " points", " km", " pages", "%", " items")


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_of(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def _phone(rng: random.Random) -> str:
    a, b, c, s = _digits(rng, 3, "23456789"), _digits(rng, 3, "23456789"), _digits(rng, 4), rng.choice(" .-")
    return rng.choice((f"{a}{s}{b}{s}{c}", f"({a}) {b}-{c}"))


def _ssn(rng: random.Random) -> str:
    return f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"


def _iban(rng: random.Random) -> str:
    value = iban_of(rng.choice(("DE", "FR", "ES", "GB", "NL", "IT")), _digits(rng, rng.choice((14, 18, 20))))
    return " ".join(value[i : i + 4] for i in range(0, len(value), 4)) if rng.random() < 0.5 else value


def _address(rng: random.Random) -> str:
    name = rng.choice(("john.smith", "jane_doe", "info", "m.mueller", "sales", "k.lopez88", "anna-b", "office", "peter", "contact"))
    host = rng.choice(("example", "mail", "web-shop", "uni", "company", "post", "acme"))
    at, dot = rng.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]")))
    return name + at + host + dot + rng.choice(("com", "org", "net", "edu", "de", "fr", "es", "io", "co" + dot + "uk"))


def _prose(rng: random.Random) -> str:
    """Words around ``at`` and ``dot`` that are no address."""
    words = ("noon", "home", "then", "we", "come", "left", "stop", "line", "it", "is", "go", "end", "here", "night", "me", "in", "to", "so", "point", "there")
    return f"{rng.choice(words)} at {rng.choice(words)} dot {rng.choice(words)}"


def _ip6(rng: random.Random) -> str:
    return ":".join(["2001", *(f"{rng.randrange(1 << 16):x}" for _ in range(7))])


def _pairs(rng: random.Random) -> str:
    """Eight bytes in hex, as fingerprints are written."""
    return ":".join(f"{rng.randrange(256):02x}" for _ in range(8))


def _card(rng: random.Random) -> str:
    body = _digits(rng, 15, "3456")
    value, s = body + luhn_digit(body), rng.choice("._/")
    return s.join(value[i : i + 4] for i in range(0, 16, 4))


def _dummy(value: str, rng: random.Random) -> str:
    """The value with all digits alike, or counting."""
    kind = rng.choice(("same", "count"))
    d, at = rng.choice("23456789"), iter("1234567890" * 4)
    return "".join((d if kind == "same" else next(at)) if c.isdigit() else c for c in value)


VALUES: dict[str, Callable[[random.Random], str]] = {"phone_local": _phone, "ssn": _ssn, "iban": _iban, "email_words": _address, "ip6": _ip6, "card_wide": _card}
LOOKALIKES: dict[str, Callable[[random.Random], str]] = {"email_words": _prose, "ip6": _pairs}


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[dict[str, object]]:
    """``generator``, ``personal``, ``held`` (kept from fitting) and ``text`` of every example."""
    rng, found = random.Random(seed), []
    for name, value in VALUES.items():
        for k in range(count):
            personal = k % 2 == 0
            before, own, after = rng.choice(PLAIN), value(rng), rng.choice(AFTER)
            if personal:
                if rng.random() < 0.8:
                    before = rng.choice(PLAIN) + rng.choice(CUES[name])
            else:
                kind = rng.random()
                if name == "email_words" or name in LOOKALIKES and kind < 0.6:  # an address is one, whatever stands before it
                    own = LOOKALIKES[name](rng)
                elif kind < 0.7:
                    before += rng.choice(OTHERS)
                elif kind < 0.8:
                    before, after = before + _digits(rng, 3) + " ", " " + _digits(rng, 3)
                elif kind < 0.9:
                    after = rng.choice(UNITS)
                else:
                    own = _dummy(own, rng)
                    before = rng.choice((before, rng.choice(CUES[name])))
            found.append({"generator": name, "personal": personal, "held": k % 10 < 2, "text": before + own + after})
    return found
