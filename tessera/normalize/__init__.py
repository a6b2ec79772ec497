from tessera.normalize.plan import STRATEGIES, ForeignKey, NormalizationPlan, normalize

__all__ = ["STRATEGIES", "ForeignKey", "NormalizationPlan", "normalize"]
