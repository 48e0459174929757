"""Language by compression: whole texts are learnt from, and sizes against zstandard called plainly."""

import random

import zstandard

from textlake.llm import langid_zstd as Z

WORDS = {"aa": ["stone", "river", "walk", "under", "light", "house", "green", "seven", "winter", "paper"],
         "bb": ["kivi", "joki", "kulkea", "alla", "valo", "talo", "vihrea", "seitseman", "talvi", "paperi"]}


def table(spark, header, n=200, seed=1):
    rng = random.Random(seed)
    rows = [(i, header + " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 400))), lang) for i in range(n) for lang in [("aa", "bb")[i % 2]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_a_shared_header_does_not_matter(spark):
    """The first 2,700 characters of all texts are the same licence text."""
    header = ("This licence applies to all texts whatever they are written in, and says nothing of them. " * 31)[:2700] + "\n"
    learned = Z.learn_dictionaries(table(spark, header))
    assert all(len(v) <= Z.DICT_BYTES for v in learned.values())
    asked = table(spark, "", seed=2)
    rows = Z.identify_language(asked, learned).join(asked.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_equals_plain_sizes(spark):
    """Every text, of one word or many blocks, goes to the smallest sum over its blocks, at one level."""
    learned = Z.learn_dictionaries(table(spark, ""))
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(WORDS["aa"] + WORDS["bb"]) for _ in range(n))) for i, n in enumerate([1, 1, 2, 3, 5, 8, 40, 100, 150, 160, 170, 900, 4000])]
    got = {r.doc_id: r for r in Z.identify_language(spark.createDataFrame(texts, "doc_id long, text string"), learned).collect()}
    for i, text in texts:
        body, sizes = Z.letters(text), {}
        for lang, content in learned.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=Z.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(body[k:k + Z.BLOCK])) for k in range(0, len(body), Z.BLOCK))
        best = min(sizes, key=lambda k: (sizes[k], list(learned).index(k)))
        other = max(sizes.values()) if min(sizes.values()) != max(sizes.values()) else min(sizes.values())
        assert got[i].lang_pred == best and abs(got[i].margin - (other - sizes[best]) / sizes[best]) < 1e-12, text[:40]


def test_small_languages_give_larger_pieces(spark):
    rows = [(i, "x" * 10_000, "many") for i in range(300)] + [(1000, "y" * 50_000, "one"), (1001, "short", "one"), (1002, "", "none"), (1003, None, "none")]
    learned = Z.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"many", "one"}
    assert Z.DICT_BYTES - 200 < len(learned["many"]) <= Z.DICT_BYTES and len(learned["one"]) == Z.DICT_BYTES // 2 + 1 + len("short")
