"""Tables that a job stores halfway, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the folder of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves on a local master; on a cluster that is an error, since other
    machines would not see it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = "file://" + tempfile.mkdtemp(prefix="stored-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
