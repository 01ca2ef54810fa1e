from .text import array_from_text, cleaned_name, filled_score, part_count

__all__ = ["array_from_text", "cleaned_name", "filled_score", "part_count"]
