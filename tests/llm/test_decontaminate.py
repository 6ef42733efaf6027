"""Decontamination against a plain matcher, and questions with other numbers and names in four languages."""

import random
import re

from gneiss.llm.decontaminate import FEW, LITERALS, NUMBERS, RUN, UNITS, WIDE, WIDTH, contaminated

WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def small(word):
    return word.translate({i: i + 32 for i in range(65, 91)})


def template(text):
    """Tokens, and what their slots hold (None: a literal); words beside them."""
    out, words, end, was_number = [], [], 0, False
    for m in WORD.finditer(text or ""):
        word, first = small(m[0]), ord(m[0][0])
        begins = not words or any(c in "\r\n!.:?" for c in text[end : m.start()])
        number = bool(re.fullmatch("[0-9]+", word)) or word in NUMBERS
        unit = was_number and word in UNITS and not number
        name = (65 <= first <= 90 or 0xC0 <= first <= 0xDE) and not begins and not number and not unit
        kind = "<num>" if number else "<name>" if name else "<unit>" if unit else word
        if out and kind == out[-1][0] and (number or name):
            out[-1][1].append(word)
        else:
            out.append((kind, [word] if number or name or unit else None))
        words.append(word)
        end, was_number = m.end(), number
    return out, words


def sound(pairs):
    held = {}
    return all(held.setdefault(slot, value) == value for window in pairs for slot, value in window)


def leaks(doc, item):
    (d, d_words), (q, q_words) = template(doc), template(item)
    for ours, theirs, plain in ((d, q, False), ([(w, None) for w in d_words], [(w, None) for w in q_words], True)):
        size = min(WIDTH, len(theirs))
        if not theirs or plain and size < LITERALS and len(ours) != size:
            continue
        literals = lambda i: sum(v is None for _, v in theirs[i : i + size])
        least = 0 if plain else FEW if size == WIDTH else LITERALS
        for shift in range(-len(theirs), len(ours)):
            places = [i for i in range(len(theirs) - size + 1) if 0 <= i + shift <= len(ours) - size and literals(i) >= least and [t for t, _ in ours[i + shift : i + shift + size]] == [t for t, _ in theirs[i : i + size]]]
            pairs = {i: [(tuple(v), tuple(ours[k + shift][1])) for k, (_, v) in enumerate(theirs[i : i + size], i) if v is not None] for i in places}
            stretches = []
            for i in places:
                if stretches and stretches[-1][-1] == i - 1:
                    stretches[-1].append(i)
                else:
                    stretches.append([i])
            for s in stretches:
                solid = sum(literals(i) >= LITERALS or plain for i in s)
                if sound(pairs[i] for i in s):
                    if solid >= RUN or len(s) >= 2 * RUN or len(theirs) < WIDTH + RUN - 1 and solid:
                        return True
                elif any(sound(pairs[i] for i in s[a:b]) for a in range(len(s)) for b in range(a + WIDE, len(s) + 1)):
                    return True
    return False


def found(spark, docs, items):
    return {r.doc_id for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where("contaminated").collect()}


def test_like_a_plain_matcher(spark):
    rng = random.Random(8)
    words = "then the farmer sells of them to a town and they buy for with more in each".split()
    names, units = ["Anna", "Otto", "Emma", "Änne"], ["dollars", "kg", "Jahre", "heures"]

    def text(n):
        out = []
        while len(out) < n:
            out += rng.choice([[rng.choice(words)]] * 5 + [[rng.choice(names)], [str(rng.randrange(4))], [str(rng.randrange(4)), rng.choice(units)]])
        return out

    items = [(i, " ".join(text(rng.choice([3, 6, 9, 14, 30, 70])))) for i in range(30)]
    docs = []
    for i in range(240):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            at = rng.randrange(len(copy))
            copy[at] = rng.choice(names) if copy[at] in names else str(rng.randrange(4)) if copy[at].isdigit() else rng.choice(words) if rng.random() < 0.3 else copy[at]
        docs.append((i, " ".join([*text(rng.randrange(6)), *copy, *text(rng.randrange(6))])))
    want = {i for i, doc in docs if any(leaks(doc, item) for _, item in items)}
    assert 40 < len(want) < 240 and found(spark, docs, items) == want


def test_other_numbers_and_names_in_four_languages(spark):
    items = [
        (1, "So Mary buys 5 apples for 10 dollars and then Mary sells 2 apples to the farmer of the town"),
        (2, "Wenn der Händler fünf Kisten für 10 Euro kauft und dann 2 Kisten an den Bauern aus der Stadt verkauft, wie viele Kisten hat der Händler noch"),
        (3, "Quand la dame achète 5 pommes pour 10 euros et puis vend deux pommes au voisin de Lyon, combien de pommes reste-t-il dans le panier"),
        (4, "Cuando la mujer compra 5 manzanas por 10 euros y luego vende dos manzanas al vecino de Madrid, cuántas manzanas quedan en la cesta"),
    ]
    docs = [
        (1, "Well, now Anna buys 7 apples for 7 dollars and then Anna sells 7 apples to the farmer of the town today"),
        (2, "Hier steht: Wenn der Krämer sieben Säcke für 12 Dollar kauft und dann 3 Säcke an den Wirt aus der Burg verkauft, wie viele Säcke hat der Krämer noch"),
        (3, "Voici. Quand la dame achète 8 pommes pour 12 euros et puis vend trois pommes au voisin de Paris, combien de pommes reste-t-il dans le panier"),
        (4, "Mira. Cuando la mujer compra 9 manzanas por 20 euros y luego vende tres manzanas al vecino de Toledo, cuántas manzanas quedan en la cesta"),
        (5, "Hier steht: Wenn der Krämer sieben Säcke für 12 Dollar kauft und dann 3 Kisten an den Wirt aus der Burg verkauft, wie viele Fässer hat der Krämer noch"),
        (6, "The farmer of the town buys nothing and sells nothing, and nobody asks how many apples there are"),
    ]
    assert found(spark, docs, items) == {1, 2, 3, 4}


def test_a_long_copy_with_one_other_name(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    item = " ".join(x for i in range(20) for x in [rng.choice(words), rng.choice(words), "Mary", rng.choice(words), str(i), rng.choice(words)])
    other = item.replace("Mary", "Anna").translate({48 + i: 48 + (i + 3) % 10 for i in range(10)}).split()
    once = [x if i != 62 else "Otto" for i, x in enumerate(other)]
    assert once != other and once[62 - 6] == once[62 + 6] == "Anna"
    short = once[44:74]
    docs = [(1, " ".join(other)), (2, " ".join(once)), (3, " ".join(short)), (4, "pad " * 50_000 + " ".join(once)), (5, " ".join(words))]
    assert found(spark, docs, [(1, item)]) == {1, 2, 4}


def test_rows_that_repeat_a_doc_id_are_judged_each_by_itself(spark):
    item = "So Mary buys 5 apples for 10 dollars and then Mary sells 2 apples to the farmer of the town"
    docs = [(1, item.replace("Mary", "Anna")), (1, item.replace("Mary", "Otto")), (2, "nothing of it"), (2, None)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS row", "'x' AS item", "'y' AS place", "'z' AS slots")
    got = contaminated(df, spark.createDataFrame([(7, item, 1)], "item_id long, text string, row int"))
    assert sorted((r.doc_id, r.contaminated) for r in got.collect()) == [(1, True), (1, True), (2, False), (2, False)]
