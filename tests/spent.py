"""What Spark has done so far, by its own counts."""


def spent(spark):
    """Records read from files, and bytes written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(20_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.inputRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)
