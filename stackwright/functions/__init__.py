"""Column expressions over text: normalizers, splitters, file name facts and transform pipelines."""
