from tessera.infer.infer import confidence, infer, infer_typed

__all__ = ["confidence", "infer", "infer_typed"]
