"""Split results with two writers, a writer that dies, and numbers that are taken."""

import threading

from tagwright.sources.runlog import RunLog


def rows(spark, pairs, by):
    return spark.createDataFrame([(c, s, by, i) for c, s in pairs for i in range(3)], "candidate int, split int, by string, n int")


def found(log):
    out = log.results()
    return sorted({(int(r.candidate), int(r.split), r.by) for r in out.collect()}) if out is not None else []


def test_two_writers_share_no_pair(spark, tmp_path):
    log, other = RunLog(spark, str(tmp_path)), RunLog(spark, str(tmp_path))
    assert log.finished() is None and log.results() is None
    log.write("a", rows(spark, [(0, 0), (0, 1)], "a"))
    other.write("b", rows(spark, [(0, 1), (1, 0)], "b"))
    assert other.commit("b", [(0, 1), (1, 0)]) == [(0, 1), (1, 0)]
    assert log.commit("a", [(0, 0), (0, 1)]) == [(0, 0)]
    assert found(log) == found(other) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "b")]
    assert sorted(map(tuple, log.finished().collect())) == [(0, 0), (0, 1), (1, 0)]
    assert log.commit("a", [(0, 1)]) == [] and [m["number"] for m in log.manifests()] == [0, 1]


def test_a_number_is_claimed_once(spark, tmp_path):
    logs = [RunLog(spark, str(tmp_path)) for _ in range(4)]
    assert logs[0]._claim(0, '{"number": 0, "run": "a", "pairs": []}')
    assert not logs[1]._claim(0, '{"number": 0, "run": "b", "pairs": [[0, 0]]}')
    assert [m["run"] for m in logs[2].manifests()] == ["a"]


def test_a_writer_that_read_the_log_too_early_tries_again(spark, tmp_path, monkeypatch):
    log, other = RunLog(spark, str(tmp_path)), RunLog(spark, str(tmp_path))
    claim, late = log._claim, []

    def first_the_other(number, text):
        if not late:
            late.append(other.commit("b", [(0, 1)]))  # between this writer's reading and its rename
        return claim(number, text)

    monkeypatch.setattr(log, "_claim", first_the_other)
    assert log.commit("a", [(0, 0), (0, 1)]) == [(0, 0)] and late == [[(0, 1)]]
    assert log.owners() == {(0, 0): "a", (0, 1): "b"}


def test_a_writer_that_dies_has_finished_nothing(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    log.write("dead", rows(spark, [(0, 0), (0, 1)], "dead"))  # no commit
    assert log.finished() is None and found(log) == []
    log.write("next", rows(spark, [(0, 0)], "next"))
    log.commit("next", [(0, 0), (0, 1)])  # the second pair has no row
    assert found(log) == [(0, 0, "next")] and log.finished().count() == 2


def test_writers_in_threads(spark, tmp_path):
    logs, own = [RunLog(spark, str(tmp_path)) for _ in range(3)], {}
    todo = [(0, s) for s in range(4)]
    threads = [threading.Thread(target=lambda i=i: own.update({i: logs[i].commit(str(i), todo[i:] + todo[:i])})) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(p for pairs in own.values() for p in pairs) == todo
