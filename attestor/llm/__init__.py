"""Operations of a training-data pipeline. Nothing outside this folder imports it, except through the guard in __spark_entry__.py."""
