"""Prose for the tests."""

WORDS = {
    "en": "the of and to house river stone green walking under light water morning found little great open".split(),
    "de": "der die und zu haus fluss straße grün gehen unter licht wasser morgen fand klein groß offen über".split(),
}


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er", "ing", "ly"]) for _ in range(n))
