import io
import time

from grove.cli import Line
from grove.plans.progress import Meter


def test_counts_rise_within_a_phase(spark):
    """Twelve tasks on four threads, each of which takes a while, add ten each."""
    heard = []
    meter = Meter(spark.sparkContext, lambda name, n: heard.append((name, n)), every=0.02)
    count = meter.count("rows")

    def run(batches):
        for b in batches:
            time.sleep(0.3)
            count.add(b.num_rows)
            yield b

    with meter.running():
        assert spark.range(0, 120, 1, 12).mapInArrow(run, "id long").count() == 120
    numbers = [n for _, n in heard]
    assert len(numbers) > 2 and numbers == sorted(set(numbers)) and numbers[-1] == 120 and {name for name, _ in heard} == {"rows"}


def test_counts_end_with_errors(spark):
    heard = []
    meter = Meter(spark.sparkContext, lambda *x: heard.append(x))
    try:
        with meter.running():
            meter.count("rows").add(3)
            raise KeyError
    except KeyError:
        pass
    assert heard == [("rows", 3)]


def test_one_line():
    out = io.StringIO()
    line = Line(out)
    line.rise("Reading", 1234)
    line.rise("Reading", 5)
    line.end("Done: 5")
    line.end("Next: 1")
    assert out.getvalue() == "\rReading: 1234\rReading: 5   \r          \rDone: 5\nNext: 1\n"
