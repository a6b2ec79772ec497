from tessera.lineage.graph import Lineage, LineageEdge

__all__ = ["Lineage", "LineageEdge"]
