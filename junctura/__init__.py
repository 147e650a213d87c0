"""Junctura: station resolution, evidence scoring and timetable analytics as Spark jobs."""
