import hashlib
import random

import corpus_pipeline
import pytest

from quire.llm.byte_bpe import ByteBPE, split_pattern, vocabulary_path


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, folder = random.Random(7), tmp_path_factory.mktemp("corpus")
    words = [f"w{k}" for k in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    docs = [(i, text(rng.randrange(3, 9)), rng.choice(["en", "fr"]), f"s{i % 3}", 0) for i in range(240)]
    passage = text(5)
    docs += [(300 + i, f"{text(2)}\n{passage}\n{text(2)}", "en", "s0", 0) for i in range(4)]
    docs += [(400, docs[3][1].replace("\n", " "), "en", "s1", 0), (401, docs[3][1].replace("\n", "  "), "en", "s1", 0)]
    docs += [(500 + i, f"{text(3)} slime grub vermin slime", "en", "s2", 0) for i in range(60)]
    docs += [(700, None, None, None, None), (701, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(500 <= i < 600)) for i in [*range(200), *range(500, 545)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen[name] = {r["doc_id"]: r for r in rows}
        if name != "encoding":
            assert docs.columns == columns
    assert not [i for i in seen["toxicity"] if 500 <= i < 600] and set(range(240)) <= set(seen["toxicity"])
    cut = seen["line_dedup"]
    assert all(cut[301 + i]["text"].count("\n") == 3 for i in range(3)) and cut[300]["text"].count("\n") == 8
    assert cut[301]["n_chars"] == len(cut[301]["text"])
    assert {400, 401} & set(seen["near_dedup"]) == set() and 3 in seen["near_dedup"]
    assert len(seen["near_dedup"]) >= 240 and 0 < len(seen["mixing"]) <= len(seen["near_dedup"])
    bpe = ByteBPE(vocabulary_path(), split_pattern())
    for i, r in seen["encoding"].items():
        text = seen["mixing"][i]["text"] or ""
        assert r["ids"] == bpe.encode_batch([text])[0] and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "starts_sha256", "n_split", "ids"] and out.count() > 50
