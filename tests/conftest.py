import pytest
from pyspark.sql import SparkSession

from brightwell import Engine


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def engine(spark):
    return Engine(spark)


@pytest.fixture
def scalar(engine):
    """First cell of a batch's first result."""

    def run(text, **parameters):
        command = engine.connect().create_command(text)
        for name, value in parameters.items():
            command.parameters.add(name, value)
        return command.execute_scalar()

    return run
