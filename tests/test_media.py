"""Media of papers with sidecars, and the nested records they come from."""

import json

from corvane.operators.media import media_gallery
from corvane.sources import files
from corvane.sources.files import SEGMENT, segmentation_records

FIELDS = "type string, page int, pair_id string, bbox array<int>, png_path string, caption_text string, has_caption boolean, caption_bbox array<int>"
RECORD = "pid string, paper_id string, pos int, seq_id string, caption string, " + FIELDS
SIDE = "pid string, name string, paper_id string, seq_id string, " + FIELDS + ", ocr struct<b_text:string,b_score:double,a_text:string,a_score:double>"
IMAGE = "pid string, name string, path string"
BOX = [1, 2, 3, 4]


def record(pos, seq, kind="Figure", page=1, png="/x/f.png", cap=None, lock=True, pair="fig.1", text=None, box=None, paper="a"):
    return ("p", paper, pos, seq, cap, kind, page, pair, BOX, png, text, lock, box)


def side(name, seq, paper="a", kind="Figure", page=9, png=None, lock=None, box=None, pair="s", text=None, ocr=None):
    return ("p", name, paper, seq, kind, page, pair, BOX, png, text, lock, box, ocr)


def gallery(spark, records, sides, images, kind="figure"):
    out = media_gallery(spark.createDataFrame(records, RECORD), spark.createDataFrame(sides, SIDE), spark.createDataFrame(images, IMAGE), kind)
    return [(r.paper_id, r.n, r.seq_id, r.page, r.picture, r.caption_text, r.ocr_text) for r in out.orderBy("paper_id", "n").collect()]


def test_records_with_what_sidecars_add(spark):
    images = [("p", "f.png", "/x/f.png"), ("p", "z_p2_figure_1_crop.PNG", "/x/z.png"), ("p", "a_p2_figure_1.png", "/x/a.png"), ("q", "p9_figure_9.png", "/q/p9.png")]
    sides = [side("1.json", "p2_figure_1", lock=True, text="Figure 2: from the side", ocr=("read b", 0.4, "Figure 9. read a", 0.9)), side("0.json", "p2_figure_1", text="older"), side("2.json", "p1_figure_2", box=BOX, ocr=(None, None, "Figure 1. by eye", 0.5))]
    records = [
        record(0, "p2_figure_1", lock=None, page=None, png="/gone.png"), record(1, " p1_figure_2 ", lock=False, pair=" "), record(2, "p1_figure_2", cap="second of one id"), record(3, "p1_figure_10", text="see Figure 3. own"), record(4, "p1_figure_3", lock=None), record(5, "p9_figure_9", png=None),
        record(6, None), record(7, "t", kind="Table"), record(8, "odd", page=3, cap="plain words"),
    ]
    got = gallery(spark, records, sides, images)
    assert got == [
        ("a", 1, "p1_figure_2", 1, "/x/f.png", "Figure 1. by eye", "Figure 1. by eye"), ("a", 2, "p1_figure_10", 1, "/x/f.png", "Figure 3. own", ""), ("a", 3, "p2_figure_1", 9, "/x/a.png", "Figure 2: from the side", "Figure 9. read a"),
        ("a", 4, "odd", 3, "/x/f.png", "plain words", ""),
    ]


def test_papers_without_media_take_their_own_sidecars(spark):
    images = [("p", "f.png", "/x/f.png"), ("p", "p5_equation_1.png", "/x/e.png")]
    sides = [side("1.json", "p3_figure_1", paper="b", lock=True, png="/x/f.png", ocr=("Figure 4: seen", 0.9, None, None)), side("2.json", "p3_figure_2", paper="b", png="/x/f.png"), side("3.json", "p3_figure_3", paper="", lock=True, png="/x/f.png"), side("4.json", "p5_figure_9", lock=True, png="/x/f.png"), side("5.json", "p5_equation_1", paper="b", kind="equation")]
    records = [record(0, "p1_figure_1"), record(1, "p1_figure_1", paper="b", lock=None)]
    assert gallery(spark, records, sides, images) == [("a", 1, "p1_figure_1", 1, "/x/f.png", "", ""), ("b", 1, "p3_figure_1", 9, "/x/f.png", "Figure 4: seen", "Figure 4: seen")]
    assert gallery(spark, records, sides, images, "equation") == [("b", 1, "p5_equation_1", 9, "/x/e.png", "", "")]
    assert gallery(spark, [], [], []) == []


def test_nested_records_are_read_whole(spark, tmp_path):
    good = {"papers": {"a": {"records": [{"seq_id": "p1_figure_1", "type": "Figure", "page": 1, "bbox": BOX, "has_caption": True}, None, {"seq_id": "x", "extra": 1}]}, "b": {}, "c": {"records": []}}}
    (tmp_path / "p-1_vns.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "q_vns.json").write_text('{"papers": ')
    (tmp_path / "r_vns.json").write_text("{}")
    rows = segmentation_records(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pid, r.paper_id, r.pos, r.seq_id, r.type, r.bbox, r.has_caption) for r in rows] == [("p-1", "a", 0, "p1_figure_1", "Figure", BOX, True), ("p-1", "a", 2, "x", None, None, None)]
    assert set(rows[0].asDict()) == {"pid", "paper_id", "pos", *(c.split()[0] for c in SEGMENT.split(", "))}


def test_files_of_several_lines_are_one_row(spark, tmp_path):
    (tmp_path / "s.gt.txt").write_text("two\nlines\n")
    (tmp_path / "s.pred.txt").write_text("two\nlimes")
    rows = files.prediction_pairs(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and "two\nlines\n" in tuple(rows[0]) and "two\nlimes" in tuple(rows[0])
    (tmp_path / "doc.json").write_text('{\n "a": 1\n}')
    docs = files.read_documents(spark, str(tmp_path / "doc.json"), "a int").collect()
    assert [(r.doc.a, r.quality) for r in docs] == [(1, "ok")]
