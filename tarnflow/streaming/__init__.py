"""tarnflow.streaming"""
