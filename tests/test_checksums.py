import hashlib

from corpuscle.plans import linking
from corpuscle.sources import tables


def test_every_file_of_a_folder(spark, tmp_path):
    want = {}
    for name in ("documents.parquet/part-0.parquet", "page.parquet/part-0.parquet", "eval_item.parquet", "with blank.tsv"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode() * 3)
        want[name] = (hashlib.md5(name.encode() * 3).hexdigest(), len(name) * 3)
    got = linking.file_checksums(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r.file: (r.md5, r.bytes) for r in got} == want
    assert [r.file for r in tables.checksums(spark, str(tmp_path / "eval_item.parquet")).collect()] == ["eval_item.parquet"]
