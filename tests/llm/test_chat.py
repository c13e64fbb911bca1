from groundset.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def _dialogues(spark, rows):
    out = {}
    for r in chat.perspectives(spark.createDataFrame(rows, TURNS)).collect():
        out.setdefault((r.conv_id, r.perspective), []).append(r)
    return {k: sorted(v, key=lambda r: r.position) for k, v in out.items()}


def test_each_speaker_in_turn_is_the_assistant(spark, monkeypatch):
    monkeypatch.setattr(chat, "BUCKET", 2)
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yes?"), (1, 3, "ann", "Bye"), (1, 4, "eve", None)]
    got = _dialogues(spark, rows)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "eve")}
    for (_, who), segments in got.items():
        whole = "".join(s.segment for s in segments)
        assert [s.position for s in segments] == list(range(5))
        assert whole.startswith("<|im_start|>system\nBe kind.<|im_end|>\n")
        learned = []
        for s, (_, _, speaker, text) in zip(segments, rows, strict=True):
            assert whole[s.start : s.end] == s.segment and s.speaker == speaker
            role = "system" if speaker == "system" else "assistant" if speaker == who else "user"
            assert s.as_role == role and (f"user name={speaker}\n" in s.segment) == (role == "user")
            if role == "assistant":
                learned.append(whole[s.train_start : s.train_end])
                assert learned[-1] == f"{text or ''}<|im_end|>"
            else:
                assert s.train_start is None and s.train_end is None
        assert len(learned) == sum(r[2] == who for r in rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 0, "a", "x"), (None, 0, "a", "x"), (2, 0, "system", "only"), (3, 1, " b ", "")]
    got = _dialogues(spark, rows)
    assert set(got) == {(None, "a"), (None, ""), (3, "b")}
    assert [s.speaker for s in got[None, "a"]] == ["a", "a", ""]
    assert [s.position for s in got[None, ""]] == [0, 1, 2]
    assert chat.perspectives(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation(spark):
    df = spark.range(5000).selectExpr(
        "1 as conv_id", "id as turn", "if(id % 2 = 0, 'a', 'b') as role", "repeat('w', cast(id % 7 as int)) as text",
        "5 as perspective",
    )
    rows = chat.perspectives(df).where("perspective = 'a'").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(5000))
    assert all(a.end == b.start for a, b in zip(rows, rows[1:]))  # noqa: B905
