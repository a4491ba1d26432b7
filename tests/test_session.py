import pytest

from clientlens import session


class Conf:
    def get(self, key, default=None):
        return default


class Context:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"


class Session:
    conf = Conf()

    def __init__(self, master):
        self.sparkContext = Context(master)


def test_the_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or session.shared_dir(spark) == named.rstrip("/")
    assert spark.sparkContext.applicationId in session.new_path(spark, "x")


def test_only_a_local_master_may_use_a_folder_of_its_own():
    first = session.shared_dir(Session("local[2]"))
    assert first == session.shared_dir(Session("local[2]"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("spark://host:7077"))


def test_staged_tables_are_read_back_and_discarded(spark):
    df = session.stage(spark.range(5), "probe")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 5 and session.path_exists(spark, path)
