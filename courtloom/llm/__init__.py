"""Text operators over clip narrations (job_id, summary, lang, narration_angle) for training-data work.

A narration is the project's one free-text record: the summary that the narrator writes for a job. Every
operator here takes a table of narrations; `queries` maps the driver's tables onto that interface.
"""
