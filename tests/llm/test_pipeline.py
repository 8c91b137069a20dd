"""The stages in order, each on what the one before kept."""

import sys
from pathlib import Path

import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from riftscan.llm.byte_bpe import ranks_of  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(after <= before for before, after in zip(kept, kept[1:], strict=False))
    encoded = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(cp.RANKS).by_bytes, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(encoded) == docs.count()
    assert all(r.decoded == texts[r.doc_id] and list(r.ids) == library.encode_ordinary(r.decoded) for r in encoded)


def test_run(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 0


def test_clean_documents_stay(spark, tmp_path):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(80)), "en", f"s{i % 2}", 0) for i in range(40)]
    copies = [(100 + i, clean[i][1], "en", "s0", 0) for i in range(5)]
    passage = " ".join(f"p{k}" for k in range(60))
    repeats = [(200 + i, " ".join(f"own{i}y{k}" for k in range(60)) + "\n" + passage, "en", "s1", 0) for i in range(3)]
    toxic = [(300 + i, f"you stupid idiot number{i} go away{i}", "en", "s1", 0) for i in range(20)]
    folder = str(tmp_path)
    spark.createDataFrame(clean + copies + repeats + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 0) for r in clean] + [(r[0], 1) for r in toxic], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = cp.stored(cp.drop_toxic(spark, docs, folder))
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in clean + copies + repeats}
    docs = cp.stored(cp.drop_near_duplicates(spark, docs, folder))
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in clean + repeats}
    docs = cp.cut_repeated_passages(spark, docs, folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r[0]] == r[1] for r in clean) and texts[200] == repeats[0][1]
    assert all("p1 " not in texts[200 + i] and f"own{i}y59" in texts[200 + i] for i in (1, 2))
