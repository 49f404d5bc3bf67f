from wordloom.sources.text import parse_labelled_lines, read_labelled_text


def test_record_rules(spark):
    lines = ["", "no tab here", "ham\t", "ham\tone\ttwo", " spam\tpadded  ", 'ham\t"quoted" text', "   "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "row_id long, value string")
    got = {r["row_id"]: (r["label"], r["text"]) for r in parse_labelled_lines(df, keep=("row_id",)).collect()}
    assert got == {3: ("ham", "one\ttwo"), 4: ("spam", "padded"), 5: ("ham", '"quoted" text')}


def test_file_order_ids(spark, tmp_path):
    p1 = tmp_path / "a.tsv"
    p1.write_text("ham\tfirst\n\nspam\tsecond\nbad\nham\tthird\n", encoding="utf-8")
    got = read_labelled_text(spark, str(p1)).orderBy("row_id").collect()
    assert [(r["label"], r["text"]) for r in got] == [("ham", "first"), ("spam", "second"), ("ham", "third")]
    assert [r["row_id"] for r in got] == [0, 2, 4]
    head = read_labelled_text(spark, str(p1), limit=2).collect()
    assert [r["text"] for r in head] == ["first", "second"]


def test_file_order_ids_across_files_and_splits(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    (d / "a.tsv").write_text("".join(f"ham\ta{i}\n" for i in range(300)), encoding="utf-8")
    (d / "b.tsv").write_text("".join(f"spam\tb{i}\n" for i in range(200)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # several splits per file
    try:
        rows = read_labelled_text(spark, str(d)).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["text"] for r in rows] == [f"a{i}" for i in range(300)] + [f"b{i}" for i in range(200)]
    assert [r["row_id"] for r in rows] == list(range(500))
