"""Fields of invented references in five styles, and their use in resolving citations."""

import random

from gleanery.operators import drafts, reference_fields as R

NAMES = "Lee Kim Noor Berg Ek Okafor Silva Rossi Novak Tanaka Müller Haddad Byrne Costa".split()
SMALL = "of the in on for and with under from between".split()
TOPICS = "river ice bridge wind flood snow glacier harbour island storm valley forest basin delta soil lake".split()
VENUES = ["Journal of Hydrology", "Water Resources Research", "Proceedings of the North Sea Conference", "Annals of Ice", "Nature Geoscience", "Cambridge University Press"]


def invent(rng):
    people = [(n, "".join(rng.choice("ABCDEFGHJKLMNPRST") for _ in range(rng.choice([1, 1, 2])))) for n in rng.sample(NAMES, rng.randrange(1, 5))]
    words = [rng.choice(TOPICS)] + [w for _ in range(rng.randrange(1, 4)) for w in (rng.choice(SMALL), rng.choice(TOPICS))]
    return {"people": people, "year": rng.randrange(1950, 2024), "title": " ".join(words).capitalize(), "venue": rng.choice(VENUES), "volume": rng.randrange(1, 90), "pages": (p := rng.randrange(1, 800), p + rng.randrange(2, 30)), "doi": f"10.{rng.randrange(1000, 9999)}/x{rng.randrange(10_000)}" if rng.random() < 0.4 else None}


def styles(r):
    dots = lambda i: ". ".join(i) + "."
    tail = lambda pre: f" {pre}{r['doi']}" if r["doi"] else ""
    last = [f"{n}, {dots(i)}" for n, i in r["people"]]
    front = [f"{dots(i)} {n}" for n, i in r["people"]]
    joined = lambda x, word: x[0] if len(x) == 1 else ", ".join(x[:-1]) + f", {word} {x[-1]}"
    a, b = r["pages"]
    yield f"{joined(last, '&')} ({r['year']}). {r['title']}. {r['venue']}, {r['volume']}, {a}–{b}.{tail('https://doi.org/')}"
    yield f"{joined(front, 'and')}, “{r['title']},” {r['venue']}, vol. {r['volume']}, pp. {a}–{b}, {r['year']}.{tail('doi: ')}"
    yield f"{', '.join(f'{n} {i}' for n, i in r['people'])}. {r['title']}. {r['venue']}. {r['year']};{r['volume']}:{a}-{b}.{tail('doi:')}"
    yield f"{joined(last, 'and')} {r['year']}. \"{r['title']}.\" {r['venue']} {r['volume']}: {a}–{b}.{tail('https://doi.org/')}"
    yield f"{joined(front, 'and')}. {r['title']}. In {r['venue']}, pages {a}–{b}, {r['year']}."


def test_f1_over_invented_references():
    rng = random.Random(8)
    right = {k: 0 for k in ("surnames", "year", "title", "venue")}
    total = 0
    for _ in range(300):
        r = invent(rng)
        for raw in styles(r):
            got = R.fields(raw)
            total += 1
            right["surnames"] += got["surnames"] == [n for n, _ in r["people"]]
            right["year"] += got["year"] == r["year"]
            right["title"] += got["title"] == r["title"]
            right["venue"] += bool(got["venue"]) and r["venue"] in got["venue"]
    share = {k: round(v / total, 3) for k, v in right.items()}
    print(share)
    assert share["year"] >= 0.99 and share["surnames"] >= 0.95 and share["title"] >= 0.95 and share["venue"] >= 0.9


def test_odd_references():
    assert R.fields("") == {"surnames": None, "year": None, "suffix": None, "title": None, "venue": None, "place": None, "link": None}
    got = R.fields("van der Berg, J., & Kim, A. (2001b). On ice. Journal of Ice, 3, 1–9.")
    assert got["surnames"][-1] == "Kim" and got["suffix"] == "b" and got["year"] == 2001
    assert R.fields("1234 5678")["title"] is None and R.fields("only words here without any mark")["title"]


def test_a_draft_is_resolved_against_its_own_list(spark):
    text = "Ice moved (Lee et al., 2001) and (Kim & Noor, 1999), but not [2].\n\nReferences\n[1] Lee, A., Ek, B., & Silva, C. (2001). On river ice. Journal of Hydrology, 3, 1–9.\n[2] Kim, D., & Noor, E. (1999). Under the bridge. Annals of Ice, 4, 10–19.\n"
    df = spark.createDataFrame([(1, text, False)], "draft_id long, text string, latex boolean")
    found = drafts.resolve(drafts.markers(df), R.read_fields(drafts.references(df))).collect()
    assert {r["value"]: (r["ordinal"], r["status"]) for r in found} == {"Lee et al., 2001": (1, "planned"), "Kim, Noor, 1999": (2, "planned"), "2": (2, "planned")}
