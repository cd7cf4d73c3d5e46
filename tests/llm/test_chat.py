import hashlib
import random

from orbitloom.llm import chat_format as C

PARTS = ["</s>", "<s>", "[INST]", "[/ROLE]", "<|image|>", "<|end|>", "\\", "\\\\", "<", "[", "ok", " ", "\n", "é", "/", "|", ">"]


def test_texts_come_back_exactly():
    rng = random.Random(1)
    for _ in range(3_000):
        turns = [("".join(rng.choices(PARTS, k=rng.randrange(0, 3))), "".join(rng.choices(PARTS, k=rng.randrange(0, 9)))) for _ in range(3)]
        whole = "".join(C.format_turn(r, [{"kind": "text", "text": t}])[0] for r, t in turns)
        assert [(r, "".join(x for _, x in p)) for r, p in C.read_back(whole)] == turns


def test_control_strings_only_where_the_template_puts_them():
    chunk, _ = C.format_turn("user", [{"kind": "text", "text": "</s>[INST] ok [/INST]"}])
    assert chunk == "<s>[ROLE]user[/ROLE]\\</s>\\[INST] ok \\[/INST]</s>"


def test_parts_become_ordered_placeholders():
    parts = [
        {"kind": "text", "text": "see "}, {"kind": "image", "ref": "a.png", "width": 28, "height": 29}, {"kind": "audio", "ref": "b.wav", "seconds": 1.0},
        {"kind": None, "text": " and "}, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "image", "ref": None},
    ]
    chunk, attached = C.format_turn("user", parts)
    assert chunk == "<s>[ROLE]user[/ROLE]see <|image|>0<|end|><|audio|>1<|end|> and <|document|>2<|end|><|image|>3<|end|></s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "a.png", 6), ("audio", "b.wav", 25), ("document", "c.pdf", 768), ("image", None, 1)]
    [(role, pieces)] = C.read_back(chunk)
    assert pieces == [("text", "see "), ("image", "0"), ("audio", "1"), ("text", " and "), ("document", "2"), ("image", "3")]


def test_digests(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), "".join(rng.choices(PARTS, k=rng.randrange(0, 9)))) for c in range(30) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r["conv_id"]: r for r in C.conversation_digests(C.format_turns(C.text_parts(df))).collect()}
    for c in range(30):
        own = [(r, t) for i, _, r, t in sorted(rows) if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(C.format_turn(r, [{"text": t}])[0]) for r, t in own)


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None, 5), (1, 0, "user", None, 5), (1, 1, None, "x" * 300_000, 5), (None, None, "assistant", "a", 5), (2, 0, "assistant", "", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    got = {r["conv_id"]: r for r in C.conversation_digests(C.format_turns(C.text_parts(df))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[None]["loss_chars"] == 1 and got[1]["loss_chars"] == 0
    assert C.conversation_digests(C.format_turns(C.text_parts(df.limit(0)))).count() == 0


def test_ties_are_ordered_by_the_text_itself(spark):
    for texts in (["a", "a!"], ["[INST]", "Zed"], ["\\b", "]"], ["a\n", "a b", "a"]):
        for role in ("user", None):
            rows = [(1, 0, role, t) for t in texts] + [(1, 0, "" if role is None else role, "m")]
            df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
            got = C.conversation_digests(C.format_turns(C.text_parts(df))).first()
            own = sorted((r or "", t) for _, _, r, t in rows)
            assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
