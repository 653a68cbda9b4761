import random

import numpy as np
import pytest

from fungo.llm import queries as Q
from fungo.llm.quality import BANDS, judge_quality, repeated_words

from .helpers import ODD, documents

WHITE = " \t\n\x0b\x0c\r"


def words(t):
    for c in WHITE:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute(t):
    ws = words(t or "")
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n


def judge(spark, pairs):
    return judge_quality(documents(spark, pairs), Q.PIECE_MODEL, Q.BPE_RANKS, Q.BPE_PATTERN).collect()


def test_base_rules_against_brute_force(spark):
    r = random.Random(1)
    pairs = [(i, "\n".join(" ".join(r.choice(["a", "b", "cé", "#d|", "e\u00a0f"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 9)))) for i in range(60)] + ODD
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = [(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in judge(spark, pairs)]
    assert sorted(got, key=key) == sorted(((i, *brute(t)) for i, t in pairs), key=key)


def test_repeats_stay_inside_a_document_and_large_vocabularies():
    ids, doc = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3]), np.array([0, 0, 0, 0, 1, 1, 1, 2, 2])
    assert repeated_words(ids, doc, 3).tolist() == [0, 0, 0]
    ids = np.array([1, 2, 3, 1 << 21, 1, 2, 3])
    assert repeated_words(ids, np.zeros(7, np.int64), 1).tolist() == [6]


@pytest.mark.parametrize("make, kept", [
    (lambda r, ws: " ".join(r.choice(ws) for _ in range(200)), True),
    (lambda r, ws: " ".join(r.choice(ws) + r.choice(("###", "$$$", "%%%", "***")) for _ in range(200)), False),
    (lambda r, ws: " | ".join(r.choice(ws) for _ in range(200)), False),
    (lambda r, ws: " ".join("".join(r.choice("qxzkvjQXZ0123456789") for _ in range(9)) for _ in range(200)), False),
])
def test_bands_tell_prose_from_noise(spark, make, kept):
    prose = "the weather was mild and people walked along river banks while children played under old trees near market square where traders sold bread fruit cheese flowers books maps lamps cloth paper tools music paint wine honey some of them came from far away villages beyond hills where winters were long and roads often closed by snow so every autumn families stored grain dried apples smoked fish and firewood in barns built with stone walls thick enough to keep out frost others sailed down to the coast in narrow boats loaded with timber wool and salt hoping for calm seas fair prices and news about their relatives who had moved years ago to the growing harbour towns".split()
    r = random.Random(6)
    assert [x.kept for x in judge(spark, [(1, make(r, prose))])] == [kept]


def fertility(t):
    """Characters a token in both vocabularies, byte share and entropy, word by word with the libraries."""
    import base64
    import math
    from collections import Counter

    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    with open(Q.BPE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    bpe = tiktoken.Encoding("w", pat_str=Q.BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(t):
        ws = words(t or "")
        ids = [i for w in ws for i in piece.encode(w)]
        n_bpe = sum(len(bpe.encode_ordinary(" " + w)) for w in ws)
        if not ids:
            return 0.0, 0.0, 0.0, 0.0
        n = len(ids)
        return sum(map(len, ws)) / n, sum(map(len, ws)) / n_bpe, sum(piece.is_byte(i) for i in ids) / n, -math.log2(sum((c / n) ** 2 for c in Counter(ids).values()))

    return [of(x) for x in t]


#: Article 1 and others of the Universal Declaration of Human Rights, a few dozen words by script.
PROSE = {
    "cyrillic": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашёнными настоящей Декларацией, без какого бы то ни было различия, как то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που προκηρύσσει η παρούσα Διακήρυξη, χωρίς καμία απολύτως διάκριση. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια.",
    "arabic": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي. لكل فرد الحق في الحياة والحرية وسلامة شخصه. لا يجوز استرقاق أو استعباد أي شخص.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחירויות שנקבעו בהכרזה זו ללא הפליה כלשהי מטעמי גזע, צבע, מין, לשון, דת, דעה פוליטית או דעה בבעיות אחרות. כל אדם יש לו הזכות לחיים, לחירות ולביטחון אישי.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है। कोई भी गुलामी या दासता की हालत में न रखा जाएगा।",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ ทุกคนย่อมมีสิทธิและอิสรภาพทั้งปวงตามที่กำหนดไว้ในปฏิญญานี้ โดยปราศจากการแบ่งแยกไม่ว่าชนิดใด บุคคลมีสิทธิในการดำเนินชีวิต ในเสรีธรรม และในความมั่นคงแห่งร่างกาย",
    "cjk": "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待 人人有资格享有本宣言所载的一切权利和自由 不分种族 肤色 性别 语言 宗教 すべての人間は 生まれながらにして自由であり かつ 尊厳と権利とについて平等である 人間は 理性と良心とを授けられており 互いに同胞の精神をもって行動しなければならない",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해 등과 같은 어떠한 종류의 차별이 없이 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다.",
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia.",
}
#: First and last of the letters that noise is drawn from.
LETTERS = {"cyrillic": (0x430, 0x44F), "greek": (0x3B1, 0x3C9), "arabic": (0x627, 0x64A), "hebrew": (0x5D0, 0x5EA), "devanagari": (0x905, 0x939), "thai": (0xE01, 0xE2E), "cjk": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3), "latin": (97, 122)}


def samples():
    """By script: prose, noise of its letters, and its bytes read as Latin-1."""
    r = random.Random(2)
    out = []
    for script, text in PROSE.items():
        ws = [x for w in text.split() for x in ([w[i : i + 12] for i in range(0, len(w), 12)] if script in ("thai", "cjk") else [w])]
        prose = [r.choice(ws) for _ in range(150)]
        noise = ["".join(chr(r.randint(*LETTERS[script])) for _ in w) for w in prose]
        out += [(script, "prose", " ".join(prose)), (script, "noise", " ".join(noise))]
        if script != "latin":
            out.append((script, "mojibake", " ".join(w.encode().decode("latin-1") for w in prose)))
    return out


def test_every_script_has_bands_that_part_prose_from_noise(spark):
    cases = samples()
    got = {x.doc_id: x for x in judge(spark, [(i, t) for i, (*_, t) in enumerate(cases)])}
    for i, (script, kind, _) in enumerate(cases):
        assert got[i].kept == (kind == "prose"), (script, kind, got[i])
        assert kind == "mojibake" or got[i].script == script


def test_fertility_against_brute_force(spark):
    pairs = [(i, t) for i, (*_, t) in enumerate(samples())] + [x for x in ODD if x[0] is not None][:8] + [(50, "αβγ abc абв"), (51, "== -- \u4e2d\u6587 a"), (52, "word " * 30_000)]
    want = {i: f for (i, _), f in zip(pairs, fertility([t for _, t in pairs]))}
    for x in judge(spark, pairs):
        assert np.allclose((x.chars_piece, x.chars_bpe, x.byte_share, x.entropy), want[x.doc_id])
        assert x.kept == (not x.base_failed and all(low <= x[n] <= high for n, (low, high) in BANDS[x.script].items()))


def test_empty_table_and_carry(spark):
    assert judge(spark, []) == []
    row = judge_quality(documents(spark, [(1, "a")]), Q.PIECE_MODEL, Q.BPE_RANKS, Q.BPE_PATTERN, carry=("text", "shard")).first()
    assert (row["_c0"], row["_c1"], row.kept) == ("a", 0.5, False)
