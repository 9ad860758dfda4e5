"""Files of the store that tables lie in, through the file system Spark itself uses there."""

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._settings = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._settings), place

    def exists(self, path: str) -> bool:
        store, place = self._at(path)
        return store.exists(place)

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder; none if there is nothing."""
        store, place = self._at(path)
        return store.getContentSummary(place).getLength() if store.exists(place) else 0

    def remove(self, path: str) -> None:
        store, place = self._at(path)
        store.delete(place, True)

    def rename(self, old: str, new: str) -> bool:
        """Whether it was done; a file of the new name is never replaced."""
        store, place = self._at(old)
        target = self._jvm.org.apache.hadoop.fs.Path(new)
        return not store.exists(target) and store.rename(place, target)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if there is no such folder."""
        store, place = self._at(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []

    def read_text(self, path: str) -> str:
        store, place = self._at(path)
        stream = store.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        store, place = self._at(path)
        stream = store.create(place, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
